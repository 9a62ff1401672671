import duckdb
from pyspark.sql import functions as F

from ledgerloom.llm.urls import Rule, decoded, judge, key_of, oracle, resolved

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def page(i, url, html=""):
    return (i, url, html, "clash", "clash")


def verdicts(spark, rows, rules=None):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, SCHEMA), rules).collect()}


def test_hosts_paths_and_longest_rules(spark):
    got = verdicts(spark, [page(1, "http://EXAMPLE.com/en/a?b#c"), page(2, "https://www.example.com/en/"), page(3, "http://notexample.com/en/"), page(4, "x://a.net/es/q"), page(5, "http://a.net?x/fr/"), page(6, None), page(7, "no scheme/com/"), page(8, "http://com"), page(9, "http://É.com/En/#/x"), page(10, "a://b://c.com/d"), page(11, "")])
    assert got == {
        1: ("example.com", "/en/a", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("notexample.com", "/en/", "com/", "allow"), 4: ("a.net", "/es/q", "net/es/", "block"),
        5: ("a.net", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("com", "", None, "allow"), 9: ("É.com", "/En/", "com/", "allow"), 10: ("b:", "//c.com/d", None, "allow"), 11: ("", "", None, "allow"),
    }


def test_aliases_share_block_decisions_and_allow_comes_first(spark):
    link = lambda to: f'<head><LINK href="{to}" rel="canonical"></head>'
    move = lambda to: f"<meta http-equiv='refresh' content='0; URL={to}'>"
    rows = [
        page(1, "http://a.org/x", link("http://b.org/y")), page(2, "https://b.org/y#f", move("/z")), page(3, "http://b.org/z", link("//bad.net/es/1")), page(4, "http://c.org/", link("http://c.org/k")),
        page(5, "http://d.org/1", link("http://bad.net/fr/2")), page(6, "http://d.org/2", link("http://d.org/1")), page(7, "http://ok.com/", link("http://d.org/2")), page(8, "http://e.org/p/q", link("r")), page(9, "http://e.org/p/r", None), page(10, "http://lone.org", "rel=canonical"), page(1, "http://a.org/x", link("http://b.org/y")),
    ]
    got = judge(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.page_id: (r.verdict, r.component) for r in got}
    assert len(got) == len(rows)
    assert [by[i][0] for i in (1, 2, 3)] == ["block"] * 3 and len({by[i][1] for i in (1, 2, 3)}) == 1
    assert [by[i][0] for i in (4, 5, 6, 7)] == ["allow"] * 4 and by[5][1] == by[7][1] != by[4][1]
    assert by[8][1] == by[9][1] == "e.org/p/q" and by[10] == ("allow", None)


def test_other_rules_and_nothing(spark):
    assert verdicts(spark, [page(1, "http://q.com/")], [])[1][2:] == (None, "allow")
    assert verdicts(spark, [page(1, "http://q.com/")], [Rule("block", "q.com", "/"), Rule("allow", "q.com", "/")])[1][2:] == ("q.com/", "allow")
    assert verdicts(spark, []) == {}


def test_references_are_resolved(spark):
    base = "a.com/b/c/d;p?q"
    want = {  # the examples of RFC 3986, section 5.4
        "http://g": "g/", "g": "a.com/b/c/g", "./g": "a.com/b/c/g", "g/": "a.com/b/c/g/", "/g": "a.com/g", "//g": "g/", "?y": "a.com/b/c/d;p?y", "g?y": "a.com/b/c/g?y", "#s": "a.com/b/c/d;p?q", "g#s": "a.com/b/c/g",
        ".": "a.com/b/c/", "./": "a.com/b/c/", "..": "a.com/b/", "../": "a.com/b/", "../g": "a.com/b/g", "../..": "a.com/", "../../g": "a.com/g", "../../../g": "a.com/g", "/./g": "a.com/g", "/../g": "a.com/g", "g.": "a.com/b/c/g.", "..g": "a.com/b/c/..g",
        "./../g": "a.com/b/g", "g/./h": "a.com/b/c/g/h", "g/../h": "a.com/b/c/h", "g?y/../x": "a.com/b/c/g?y/../x", "?next=http://x": "a.com/b/c/d;p?next=http://x", "mailto:x@y.z": None, "HTTPS://G.net/x": "g.net/x",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.k for r in df.select("t", key_of(resolved(F.lit(base), F.col("t"))).alias("k")).collect()} == want
    values = {"a&amp;b": "a&b", "&lt;&gt;&quot;&apos;": "<>\"'", "&#233;&#xe9;&#X1F600;": "éé\U0001f600", "&amp;amp;": "&amp;", "& &x; &#0; &#xD800; &#9999999; &": "& &x; &#0; &#xD800; &#9999999; &", "": ""}
    df = spark.createDataFrame([(t,) for t in values], "t string")
    assert {r.t: r.d for r in df.select("t", decoded(F.col("t")).alias("d")).collect()} == values


def test_empty_paths_queries_dots_and_entities(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    move = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [
        page(1, "https://shop.com?y=1", link("http://z.net/es/1")), page(2, "http://c2.org/z", move("https://shop.com?y=1")), page(3, "http://q.org/a/b.html", link("?p=1")), page(4, "http://q.org/a/b.html?p=1", link("http://z.net/fr/")),
        page(5, "http://u.org/a/b/c", link("../up/x")), page(6, "http://u.org/a/up/x", move("http://z.net/es/2")), page(7, "http://v.org/?a=1&b=2", link("http://z.net/es/3")), page(8, "http://v.org/k", link("/?a=1&amp;b=2")),
        page(9, "http://w.org/", link("http://z.net/es/4")), page(10, "http://w.org", ""), page(11, "http://w.org/x/..", ""), page(12, "http://ok.com/", link("http://z.net/es/5")), page(13, "http://p.org/1", link("http://ok.com/")),
        page(14, "http://s.com", link("http://z.net/es/6")), page(15, "http://r.org/1", link("http://s.com/")), page(16, None, link("http://z.net/es/6")), page(17, "http://m.org/", link("mailto:a@b")),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.component) for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, r in got.items() if r[3] == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert got[10][4] == got[11][4] == got[9][4] and got[17][4] is None  # s.com/ is allowed by name, so pages 14 and 15 pass
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in rows])
    assert {r[0]: r[1:] for r in db.execute(oracle()).fetchall()} == got
