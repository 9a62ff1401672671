"""Answers and page lines are read with each expression worked out once, with the same rows."""

from ledgerloom.functions import exprs as X
from ledgerloom.operators import rows as W
from ledgerloom.sources import readers


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_cleaned_once(spark):
    row = '{"raw_label":" Cash ","year_values":[{"year":"FY 2020-21","value":1.5},{"year":"31 Dec 2019","value":null}],"indentation_level":1.6}'
    texts = [f"Rows:\n```json\n{{\"rows\":[{row}]}}\n``` done", '{"rows":[{"raw_label":"  "},{"raw_label":"No years"}]}', "no answer", "} {", "", None, "````json{\"rows\":[]}``"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string").repartition(2)
    values = W.explode_values(readers.parse_row_payloads(df).select("id", "raw_label", "indentation_level", "raw_values"))
    assert sorted(tuple(r) for r in values.collect()) == [(0, "Cash", 2, "2019", None), (0, "Cash", 2, "2021", 1.5)]
    assert plan_of(values).count("regexp_replace") == 1 and plan_of(values).count("map_from_entries") == 1
    assert readers.parse_row_payloads(df).filter("raw_label = 'No years'").count() == 1


def test_year_keys_with_and_without_a_hyphen(spark):
    keys = {"2019-20": "2020", "FY 1999-05": "1905", "12-31-2018": "2018", "a-b": "a-b", "123456": "1234", "20182019": "2019", "": "", "2020-21 x": "2020", None: None}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.y for r in df.select("k", X.year_key("k").alias("y")).collect()} == keys


def test_lines_are_matched_once(spark):
    lines = ["Some text", " FY  2021   2020", "Cash  1,234  (5.5)", "\tTotal assets\t-3  -", "  1000 Section 3   7  8 ", " FY  2021   2020", "2019 2018", "no amounts", "", "  12  13", "Ends\t9  8\u2028", "Carriage\t4  5\r"]
    df = spark.createDataFrame([(1, 1, "\n".join(lines)), (2, 1, "no years\n1  2"), (3, 1, None), (4, 1, "")], "document_id int, page_number int, text string").repartition(2)
    out = W.extract_lines(df)
    got = sorted((r.document_id, r.line_no, r.raw_label, r.is_subtotal, r.indentation_level, r.year, r.value) for r in out.collect())
    values = {}
    for _, no, label, total, level, year, value in got:
        values.setdefault((no, label, total, level), {})[year] = value
    assert values == {
        (3, "Cash", False, 0): {"2021": 1234.0, "2020": -5.5}, (4, "Total assets", True, 0): {"2021": -3.0, "2020": None}, (5, "Section 3", False, 1): {"2021": 7.0, "2020": 8.0},
        (7, "2019", False, 0): {"2020": 2018.0}, (10, "12", False, 1): {"2020": 13.0}, (11, "Ends", False, 0): {"2021": 9.0, "2020": 8.0}, (12, "Carriage", False, 0): {"2021": 4.0, "2020": 5.0}}
    assert plan_of(out).count(W.LINE_PATTERN) == 1
