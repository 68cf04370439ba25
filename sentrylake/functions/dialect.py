"""Functions that Spark and DuckDB name differently: ``@``-marked words of a query's text and what they stand for."""

#: White space as Python's str.split() has it.
_SPACES = "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_SPARK_SPACES = _SPACES.replace("\\", "\\\\")

DIALECT = {
    "spark": {"@lengths(": "filter(transform(split(", "@l)": f", '[.!?]+'), x -> cast(regexp_count(x, '[^{_SPARK_SPACES}]+') as bigint)), x -> x > 0)", "@sum(": "aggregate(transform(", ", x@x)": ", x -> x), 0L, (a, b) -> a + b)", ", x * x@x)": ", x -> x * x), 0L, (a, b) -> a + b)",
              "@filter(": "filter(", "@it": "x -> x", "@f)": ")", "@spread": "/*+ REPARTITION({partitions}, doc_key) */",
             "@words(": "regexp_extract_all(lower(", "@w)": "), '[\\\\p{L}\\\\p{N}_]+', 0)", "@size(": "size(", "@sentences(": "filter(transform(split(", "@s)": ", '[.!?]+'), x -> trim(x)), x -> x <> '')",
              "@distinct(": "array_distinct(", "@tokens(": "size(split(trim(", "@t)": "), '[ \\n\\r\\t]+'))", "@any_value": "any_value", "@string": "string", "@explode(": "explode(", "@joined(": "concat_ws(';', collect_list(", "@j)": ")", "@end": ")", "@range": "sequence(0, 7)", "@split(": "split(", "@p)": ")", "@list(": "collect_list(", "@known(": "last_value(", "@k)": ") ignore nulls",
              "@head(": "aggregate(slice(", "@h)": "), 0L, (a, x) -> a + x)", "@matches(": "regexp_like(", "@count(": "regexp_count(", "@c)": ")", "@upper_words(": "size(filter(split(trim(", "@u)": "), '[ \\n\\r\\t]+'), x -> length(x) > 2 and upper(x) = x and lower(x) <> x))"},
    "duckdb": {"@lengths(": "list_filter(list_transform(regexp_split_to_array(", "@l)": f", '[.!?]+'), lambda x: len(regexp_extract_all(x, '[^{_SPACES}]+'))), lambda x: x > 0)", "@sum(": "cast(coalesce(list_sum(list_transform(", ", x@x)": ", lambda x: x)), 0) as bigint)", ", x * x@x)": ", lambda x: x * x)), 0) as bigint)",
               "@filter(": "list_filter(", "@it": "lambda x: x", "@f)": ")", "@spread": "",
              "@words(": "regexp_extract_all(lower(", "@w)": "), '[\\p{L}\\p{N}_]+')", "@size(": "len(", "@sentences(": "list_filter(list_transform(regexp_split_to_array(", "@s)": ", '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')",
               "@distinct(": "list_distinct(", "@tokens(": "len(regexp_split_to_array(trim(", "@t)": "), '[ \\n\\r\\t]+'))", "@any_value": "any_value", "@string": "varchar", "@explode(": "unnest(", "@joined(": "string_agg(", "@j)": ", ';')", "@end": "", "@range": "range(8)", "@split(": "string_split(", "@p)": ")", "@list(": "list(", "@known(": "last_value(", "@k)": " ignore nulls)",
               "@head(": "list_sum(list_slice(", "@h)": "))", "@matches(": "regexp_matches(", "@count(": "len(regexp_extract_all(", "@c)": "))", "@upper_words(": "len(list_filter(regexp_split_to_array(trim(", "@u)": "), '[ \\n\\r\\t]+'), lambda x: length(x) > 2 and upper(x) = x and lower(x) <> x))"},
}


def translate(sql: str, dialect: str) -> str:
    """The text with the marks replaced by the dialect's own functions."""
    for mark, real in DIALECT[dialect].items():
        sql = sql.replace(mark, real)
    return sql
