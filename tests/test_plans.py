"""Queries against DuckDB on small tables; branches that must occur; goals on hand-computed traces."""

import os

import duckdb
import pytest

from sentrylake.operators import forest
from sentrylake.operators.goals import Goals, accumulate, infer, occurs
from sentrylake.plans import additive, folds, oracles, training
from sentrylake.plans import queries as plans
from sentrylake.sources import mails, quoted
from sentrylake.streaming import correlator

SF = "/root/testdata/sf0.001"
NAMES = (
    "feature_vector", "rich_velocity", "peer_deviation", "vocabulary", "burstiness", "running_perplexity", "extract_address", "stratified_split", "detected_actor_set", "mixed_precision_eval", "reason_codes", "forensics_cache_mean",
    "clean_sample_filter", "urgency_level", "ai_text_probability", "fused_text_risk", "weighted_score", "policy_cycle_discount", "partner_allowlist", "evidence_gate", "intent_forensics_boost", "attachment_mention", "external_recipient",
    "spam_indicators", "entity_counts", "abductive_rule_hits", "goal_probability", "threat_assessment", "threat_assessment_eg", "confirmed_alerts", "early_alerts", "confirmed_alerts_eg", "confirmed_alerts_ce", "alert_payload", "ewma_baseline",
    "trust_update", "sweep_summary", "config_grid", "actor_confusion", "alert_precision", "classification_report", "tfidf_features", "parse_mail", "scan_mail_corpus", "scan_labeled_mail", "sink_event_log", "anomaly_samples", "stream_step_counts",
    "stream_actor_totals", "stream_ingest", "authorship_consistency", "author_profile", "style_metrics", "text_classifier_prob", "online_weights", "confirmed_alerts_online", "early_alerts_online", "run_average", "stream_late_data", "stream_correlate", "stream_alert_sink",
    "abductive_rule_hits_egx", "goal_probability_egx", "plan_tracking_egx", "threat_assessment_egx", "scored_anchors_egx", "early_alerts_egx", "confirmed_alerts_egx", "evaluation_egx",
    "sender_profiles", "corpus_stats", "label_filter_stats", "feature_vector_20", "feature_vector_12", "evaluation_ce", "evaluation_eg",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: str(x) if x is None or isinstance(x, (bool, str)) else f"{float(x):.9g}"
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = plans.queries()[name](spark, SF)
    want = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), columns)


def test_every_query_that_sql_can_express_has_it():
    without = set(plans.queries()) - set(plans.oracle_sql())
    assert without == {"train_classifiers", "select_classifier", "blended_phishing", "model_artifact", "isolation_forest_fit", "isolation_forest_score", "ml_nudge", "alerts_default", "sweep_summary_full"}


def test_each_branch_of_the_policies_occurs(spark):
    """Small tables, but every outcome of the discounts and of the allowlist is there."""
    cycle = plans.queries()["policy_cycle_discount"](spark, SF.replace("0.001", "0.01"))
    assert {r["mult"] for r in cycle.select("mult").distinct().collect()} == {0.7, 0.85, 1.0}
    assert {round(r["mult_eg"], 6) for r in cycle.select("mult_eg").distinct().collect()} == {0.45, 0.1575, 1.0}
    listed = plans.queries()["partner_allowlist"](spark, SF.replace("0.001", "0.01"))
    assert {(r["unapproved"], r["anchor_email"]) for r in listed.select("unapproved", "anchor_email").distinct().collect()} == {(0, 0), (1, 0), (1, 1)}
    # the profile's list and the mail's flag each approve mails that the other doesn't
    assert not listed.filter("outside_unlisted > outside_neither").isEmpty() and not listed.filter("outside > outside_unlisted").isEmpty()


def test_policy_values():
    """From the rules: no cycle, a cycle with any ticket in the window, a cycle without one; late hours that aren't allowed."""
    event = dict(event_id=1, event_type="email_send", step=70, dst="external@outside", attachment_kb=300, resource=None, action=None, bytes=None, role="staff", after_hours=False, takeover=False, device_change=False, cycle=None, ticket_id=None,
                 approved_partner=False, label="benign", phase="test", src_rank=1)
    staff = ("staff", False, None)
    plain = correlator.score(event, [event], staff)
    assert (plain["mult"], plain["off"], plain["score_base"], plain["gate"]) == (1.0, 0.0, 2.0, True)
    cycle = event | {"event_type": "db_query", "dst": None, "cycle": "partner_reporting"}
    ticket = event | {"event_type": "db_query", "dst": None, "ticket_id": "T-1"}
    assert [correlator.score(event, [cycle, event], staff)[k] for k in ("mult", "off")] == [0.85, -0.30]
    assert [correlator.score(event, [cycle, ticket, event], staff)[k] for k in ("mult", "off")] == [0.70, -0.60]
    late = correlator.score(event, [event | {"after_hours": True}], staff)
    assert (late["mult"], late["off"]) == (1.15, 0.50) and correlator.score(event, [event | {"after_hours": True}], ("staff", True, None))["mult"] == 1.0
    # mail to partners of the profile's list, or flagged, is no anchor by itself
    partner = event | {"dst": "partner@outside"}
    assert correlator.score(partner, [partner], ("analyst", True, "partner@outside")) is None
    assert correlator.score(partner, [partner | {"approved_partner": True}], staff) is None
    assert correlator.score(partner, [partner], staff)["gate"]


def test_occurs():
    assert occurs(["login", "data_export", "db_query", "email_send:external"], ("data_export", "email_send:external"))
    assert not occurs(["email_send:external", "data_export"], ("data_export", "email_send:external"))
    assert not occurs(["data_export"], ("data_export", "data_export"))


def test_goals():
    g = Goals()
    assert g.assess() == (None, 0.0, None, 0.0, 0.0, 0.0, 0.0, 0.0)
    for step, code in enumerate(["db_query:patients_table", "data_export:patients_table"]):
        g.observe(step, code)
    assert g.p == {"data_theft": 0.4}
    g.observe(2, "email_send:external")
    assert g.p["exfiltration"] == 0.5 and g.p["data_theft"] == pytest.approx(0.4 + 0.4 * 0.6)
    assert g.assess()[0] == "data_theft"


def test_goals_of_the_gated_variant():
    g = Goals("eg")
    g.observe(0, "db_query:patients_table")
    g.observe(1, "data_export:patients_table")
    assert g.p == {"data_theft": 0.4}
    # contradictions first, then the rules again
    g.observe(2, "login", 2)
    p = 0.4 * 0.85**2
    assert g.p["data_theft"] == pytest.approx(p + 0.4 * (1 - p))
    for k in range(20):
        g.observe(3, "login:%d" % k)
    p = g.p["data_theft"]
    g.observe(43, "login")
    assert g.p["data_theft"] == pytest.approx(p * 0.92**20) or "data_theft" not in g.p


def test_infer_restarts_for_each_actor(spark):
    rows = [(i, i % 2, i // 2, i // 2 + 1, code) for i, code in enumerate(["data_export", "login", "email_send:external", None])]
    got = {r["event_id"]: r for r in infer(spark.createDataFrame(rows, "event_id long, actor_id long, step long, ord long, code string")).collect()}
    assert got[2]["p_exfiltration"] == 0.5 and got[3]["p_exfiltration"] == 0.0 and len(got) == 4
    assert infer(spark.createDataFrame([], "event_id long, actor_id long, step long, ord long, code string")).count() == 0


def test_goals_that_add_up(spark):
    """Boosts are added up to 1, each contradiction leaves 0.85; actors have nothing to do with each other, nor has the order of rows."""
    rows = [(3, 1, 7, 3, True, 0, 0.25), (1, 1, 5, 1, True, 0, 0.2), (2, 1, 6, 2, True, 1, 0.2), (4, 1, 8, 4, True, 2, 0.9), (5, 2, 5, 1, True, 1, 0.0), (6, 1, 9, 5, True, 0, 0.9)]
    boosted = spark.createDataFrame(rows, "event_id long, actor_id long, step long, ord long, last_of_step boolean, contradictions long, b_x double")
    got = {r["event_id"]: r["p_x"] for r in accumulate(boosted, ("x",)).collect()}
    assert got == pytest.approx({1: 0.2, 2: 0.37, 3: 0.62, 4: 1.0, 5: 0.0, 6: 1.0})
    assert accumulate(boosted.limit(0), ("x",)).count() == 0


def test_rules_by_parts_of_codes(spark):
    """Parts are looked for anywhere in a code, in order, others between; those of another order don't count."""
    codes = {
        "a": ("db_query:patients_table", "login", "data_export:patients_table:internal"),
        "b": ("data_export:patients_table", "db_query:patients_table"),
        "c": ("db_query:sensitive",) * 3,
        "d": ("db_query:sensitive", "login", "db_query:sensitive"),
        "e": ("login:after_hours:new_device", "data_export", "db_query:sensitive_rows", "email_send:external"),
        "f": ("",),
    }
    df = spark.createDataFrame([(k, ";" + ";".join(v) + ";") for k, v in codes.items()], "k string, codes string")
    got = {r["k"]: [i for i in range(4) if r[f"rule_{i}"]] for r in df.selectExpr("k", *(f"regexp_like(codes, '{additive._parts(w)}') as rule_{i}" for i, (w, _, _) in enumerate(additive.RULES))).collect()}
    greedy = lambda seen, wanted: all(any(w in c for c in it) for it in [iter(seen)] for w in wanted)
    assert got == {k: [i for i, (w, _, _) in enumerate(additive.RULES) if greedy(v, w)] for k, v in codes.items()}
    assert got == {"a": [0], "b": [], "c": [2], "d": [], "e": [1, 3], "f": []}


@pytest.mark.parametrize("variant, dated", [("eg", True), ("ce", False)])
def test_evaluation_by_plain_loops(spark, con, variant, dated):
    """Sets of actors, first steps and counts from the alerts' own rows."""
    q = plans.queries()
    told = [(t, r) for t in ("early", "confirmed") for r in q[f"{t}_alerts_{variant}"](spark, SF).collect() if r["phase"] == "test"]
    bad = {}
    for r in q["actor_truth"](spark, SF).collect():
        if r["malicious"]:
            bad[r["actor_id"]] = r["first_step"]
    conf = [r for t, r in told if t == "confirmed"]
    found = {r["actor_id"] for r in conf} & set(bad)
    firsts = {a: min(r["step"] for r in conf if r["actor_id"] == a) for a in found}
    gaps = [firsts[a] - bad[a] for a in found if not dated or (firsts[a] and bad[a])]
    got = q[f"evaluation_{variant}"](spark, SF).first()
    assert (got["conf_total"], got["conf_fp"], got["early_total"]) == (len(conf), sum(r["label"] != "malicious" for r in conf), sum(t == "early" for t, _ in told))
    assert (got["actors_total"], got["actors_detected"], got["ttd_max"]) == (len(bad), len(found), max(gaps, default=0))
    p, r = len(found) / max(1, len({x["actor_id"] for x in conf})), len(found) / max(1, len(bad))
    assert (got["actor_precision"], got["actor_recall"], got["actor_f1"]) == pytest.approx((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    assert got["ttd_avg"] == pytest.approx(sum(gaps) / len(gaps) if gaps else 0.0)


def test_parse_mail(spark):
    multi = "From: A <a@x>\nTo: b@y\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>no</p>\n--q\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nw6kgeWVz\n--q--\n"
    got = {r.mail_id: r for r in mails.parse(spark.createDataFrame([(1, multi), (2, None), (3, "no headers at all")], "mail_id long, message string")).collect()}
    assert (got[1].sender, got[1].recipients, got[1].subject, got[1].body.strip(), got[1].failed) == ("A <a@x>", "b@y", "s", "é yes", False)
    assert got[2].failed and not got[3].failed
    assert mails.parse(spark.createDataFrame([], "mail_id long, message string")).count() == 0


def _forest_rows():
    """Two roles; role a has two models, the second from samples that lie elsewhere."""
    rng = __import__("random").Random(1)
    near = [("a", 10, i, 0, 1 + i % 3, rng.gauss(3, 1), rng.gauss(2, 1)) for i in range(300)]
    far = [("a", 25, i, 15, 1, rng.gauss(103, 1), rng.gauss(102, 1)) for i in range(300)]
    return near + far


@pytest.mark.parametrize("most", [20_000, 10])
def test_forest(spark, monkeypatch, most):
    """Vectors far from the samples of their role's latest model score highest; before the first model, and for another role, nothing does. Broadcast or dealt by model."""
    monkeypatch.setattr(forest, "BROADCAST_TREES", most)
    samples = spark.createDataFrame(_forest_rows(), "role string, version long, actor_id long, step long, weight int, x double, y double")
    trees = forest.fit(samples, ["x", "y"], trees=50)
    assert sorted((r.role, r.version, r["count"]) for r in trees.groupBy("role", "version").count().collect()) == [("a", 10, 50), ("a", 25, 50)]
    v = spark.createDataFrame([("a", 1, 5, 90.0, 90.0), ("a", 2, 12, 90.0, 90.0), ("a", 3, 12, 3.0, 2.0), ("a", 4, 30, 3.0, 2.0), ("a", 5, 30, 103.0, 102.0), ("b", 6, 30, 1.0, 1.0), ("a", 7, 30, None, None)], "role string, actor_id long, step long, x double, y double")
    got = {r.actor_id: r for r in forest.score(v, ["x", "y"], trees, samples).collect()}
    assert {k: r.version for k, r in got.items()} == {1: None, 2: 10, 3: 10, 4: 25, 5: 25, 6: None, 7: 25}
    assert got[1].anomaly == 0 == got[6].anomaly and got[2].anomaly > 0 and got[3].anomaly == 0 and got[4].anomaly > 0 and got[5].anomaly == 0 and got[7].anomaly > 0


def test_versions_of_scores(spark):
    """Each window is scored by the latest fit of its role, by SQL over the versions."""
    scored = plans.queries()["isolation_forest_score"](spark, SF)
    fits = plans.queries()["anomaly_samples"](spark, SF).select("role", "version").distinct()
    scored.createOrReplaceTempView("scored_"), fits.createOrReplaceTempView("fits_")
    assert spark.sql("select count(*) from scored_ s where not (s.version <=> (select max(f.version) from fits_ f where f.role = s.role and f.version <= s.step))").first()[0] == 0
    assert scored.filter("version is not null").count() > 0


@pytest.mark.parametrize("size", ["1k", "300b", "128m"])
def test_quoted_csv(spark, tmp_path, size):
    """One file with long, empty and broken records: the rows of Spark's own reader, from many splits."""
    rng = __import__("random").Random(2)
    path = str(tmp_path / "a.csv")
    texts = ["plain", "", 'a "quoted" word, and\na break', "x" * 1500 + "\n" * 40 + '"' * 9, "\r\nwindows\r\n", "é 日本", "trailing \\ backslash", 'ends with "']
    rows = [(str(i), rng.choice(texts) * rng.randrange(1, 4)) for i in range(120)]
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write('file,"Message"\n' + "".join(f'{i},"{t.replace(chr(34), chr(34) * 2)}"{rng.choice([chr(10), chr(13) + chr(10)])}' for i, t in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = quoted.read(spark, path, ["file", "message", "none"])
        assert sorted((r["file"], r["message"], r["none"]) for r in got.collect()) == sorted((i, t, None) for i, t in rows)
        if size != "128m":
            assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert sorted(x for x, in mails.read_corpus(spark, path).collect()) == sorted(t for _, t in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_csv_cases(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.csv").write_bytes(b'Message,n\n"caf\xe9 \xff",1\n\n"too long for the limit",2\nshort\n')
    (tmp_path / "d" / "two.csv").write_bytes(b'n,message\r\n3,"other order"\r\n4')
    got = sorted((r["message"] or "", r["n"] or "") for r in quoted.read(spark, str(tmp_path / "d"), ["message", "n"], limit=15).collect())
    assert got == [("", "4"), ("caf\ufffd \ufffd", "1"), ("other order", "3"), ("short", "")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_bytes(b"")
    assert quoted.read(spark, str(tmp_path / "e"), ["message"]).count() == 0


def test_classifiers_beat_chance(spark):
    assert training.select_classifier(spark, SF.replace("0.001", "0.01")).first()["accuracy"] > 0.6


def test_sql_of_the_folds_names_all_plans():
    assert "exfil_staged" in folds.goals("eg") and "cred_theft" not in folds.goals("eg") and "cred_theft" in folds.goals("ce")
    assert len(oracles.CONFIGURATIONS) == 5


def test_mail_corpus_keeps_white_space(spark, tmp_path):
    """Mails that end with white space come back whole, and a null stays one."""
    texts = ["ends with a break\n", "spaces  ", "", "return\r", "tab\t\n\n", "plain"]
    spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(str(x) for x, in training.scan_mail_corpus(spark, str(tmp_path)).collect()) == sorted(str(x) for x, in c.execute(training.ORACLE_SQL["scan_mail_corpus"]).fetchall())


def test_perplexity_of_odd_events(spark, tmp_path, monkeypatch):
    """Mails without a time, delivered twice, and documents that stand there twice; chunks and buckets of few mails and words."""
    from sentrylake.operators import perplexity

    monkeypatch.setattr(perplexity, "CHUNK", 7)
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    c.execute(f"copy (select event_id, case when event_id % 11 = 5 then null else ts end as ts, user_id, event_type, value, props from '{SF}/events.parquet', range(2) r(i) where i = 0 or event_id % 3 = 0) to '{tmp_path}/events.parquet' (format parquet)")
    c.execute(f"copy (select doc_id, case when doc_id % 9 = 4 then null when i = 1 then 'again ' || text else text end as text from '{SF}/documents.parquet', range(2) r(i) where doc_id % 5 <> 3 and (i = 0 or doc_id % 4 = 1)) to '{tmp_path}/documents.parquet' (format parquet)")
    c.execute(f"copy (select * from '{SF}/labels.parquet') to '{tmp_path}/labels.parquet' (format parquet)")
    for t in ("events", "documents", "labels"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = plans.queries()["running_perplexity"](spark, str(tmp_path)), c.execute(plans.oracle_sql()["running_perplexity"])
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), [d[0] for d in want.description])


def test_terms_are_counted_before_they_are_shuffled(spark, tmp_path):
    """No row of a document's term is shuffled for the vocabulary; ids that stand there twice are one document, as in the SQL."""
    plan = training.tfidf_features(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(doc_id" not in plan
    c = duckdb.connect()
    c.execute(f"copy (select doc_id, text from '{SF}/documents.parquet', range(3) r(i) where i = 0 or doc_id % (i + 2) = 1 union all select null, 'words without an id ' || i from range(5) r(i)) to '{tmp_path}/documents.parquet' (format parquet)")
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got, want = training.tfidf_features(spark, str(tmp_path)), c.execute(training.ORACLE_SQL["tfidf_features"])
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), [d[0] for d in want.description])


def test_words_of_senders_are_not_shuffled(spark):
    """Mails go to their sender as texts: no exchange by sender and word."""
    plan = training.vocabulary_sketches(spark, SF)._jdf.queryExecution().executedPlan().toString()
    by_sender = [x for x in plan.splitlines() if "hashpartitioning(actor_id" in x]
    assert by_sender and not any("word" in x.split("hashpartitioning(")[1].split(")")[0] for x in by_sender)
