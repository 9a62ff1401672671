"""URL filters: rules by host and path, and redirect equivalence for the URLs no rule names.

Redirects (meta refresh) and canonical links make URLs aliases of each other; connected components of these edges
share one decision: block where a member is blocked by a rule and none is explicitly allowed, else allow. A rule of
a URL's own always comes first. References are resolved by RFC 3986. DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components
from ledgerloom.session import materialise, tune


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """The path with its `.` and `..` segments resolved."""
    step = lambda done, seg: F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(seg == ".", done).otherwise(F.concat(done, F.array(seg)))
    segments = F.split(F.substring(path, 2, F.length(path)), "/")
    last = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(last, F.array().cast("array<string>"), step), "/"))
    return F.when(F.startswith(path, F.lit("/")) & path.contains("/."), resolved).otherwise(path)


def query_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)


def key_of(rest: Column) -> Column:
    """A URL's node: host, path and query, without scheme and fragment; dot segments are resolved, an empty path is `/`."""
    path = without_dots(path_of(rest))
    return F.concat(host_of(rest), F.when(path == "", "/").otherwise(path), query_of(rest))


def resolved(rest: Column, to: Column) -> Column:
    """What follows the scheme's `://` in the target of a reference on a page, or null if that is no page of the web.

    By RFC 3986: references with an authority, absolute paths, queries, fragments and relative paths; dot segments are
    left to `key_of`. `rest` is the page's own url after its scheme.
    """
    host, path = F.regexp_extract(rest, r"^([^/?#]*)", 1), path_of(rest)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    return (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), after_scheme(to)).when(F.startswith(to, F.lit("//")), F.substring(to, 3, F.length(to))).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(F.startswith(to, F.lit("/")), F.concat(host, to)).when(F.startswith(to, F.lit("?")), F.concat(host, path, to)).when(F.startswith(to, F.lit("#")), rest).otherwise(F.concat(host, folder, to)))


def decoded(value: Column) -> Column:
    """An attribute's value with numbered and the five basic named character references replaced."""
    pieces = F.regexp_extract_all(value, F.lit(r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);|[^&]+|&)"), F.lit(1))
    named = lambda p: F.when(p == "&amp;", "&").when(p == "&lt;", "<").when(p == "&gt;", ">").when(p == "&quot;", '"').when(p == "&apos;", "'").otherwise(p)
    point = lambda p: F.when(p.rlike(r"^&#[xX].*;$"), F.conv(F.regexp_extract(p, "([0-9a-fA-F]+);", 1), 16, 10)).when(p.rlike(r"^&#.*;$"), F.regexp_extract(p, "([0-9]+);", 1)).cast("int")
    valid = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    shown = lambda p: F.when(valid(point(p)), F.decode(F.unhex(F.lpad(F.hex(point(p)), 8, "0")), "UTF-32")).otherwise(named(p))
    return F.when(value.contains("&"), F.array_join(F.transform(pieces, shown), "")).otherwise(value)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null; of equal ones the one that allows.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.array(*(F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in ordered))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.when(F.size(fits) > 0, F.struct(fits[0]["rule"].alias("rule"), fits[0]["verdict"].alias("verdict")))


def references(pages: DataFrame) -> DataFrame:
    """(rest, there): a page's url and the target of its canonical link or meta refresh, both after the scheme."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    canonical = attribute(F.regexp_extract("html", r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0), "href")
    refresh = attribute(F.regexp_extract("html", r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0), "url")
    found = pages.where("url IS NOT NULL").where(F.col("html").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    found = found.select(after_scheme(F.col("url")).alias("rest"), F.explode(F.array(canonical, refresh)).alias("to")).where("to <> '' AND rest <> ''")
    return found.select("rest", resolved(F.col("rest"), decoded(F.col("to"))).alias("there")).where("there IS NOT NULL")


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of `pages` (page_id, url, html; more are ignored).

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the
    end; both empty for null or without `://`. `component` is the smallest node of the page's aliases, null where it
    has none. The members of a component are the pages on its nodes and the targets of their references; each is judged
    by the path it has (an empty one fits no rule), a target's after its dot segments. Null html links to nothing.
    Rows that repeat a url share its node.
    """
    tune(pages.sparkSession)
    rules = RULES if rules is None else rules
    found = materialise(references(pages))
    nodes = materialise(components(found.select(key_of(F.col("rest")).alias("a"), key_of(F.col("there")).alias("b"))))
    member = nodes.select(F.col("id").alias("node"), "component")
    rest = after_scheme(F.col("url"))
    judged = pages.select("page_id", host_of(rest).alias("host"), path_of(rest).alias("path"), F.when(rest != "", key_of(rest)).alias("node"))
    judged = materialise(judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(member, "node", "left").drop("node"))
    there = F.col("there")
    targets = found.select(key_of(there).alias("node"), rule_of(host_of(there), without_dots(path_of(there)), rules)["verdict"].alias("own")).distinct().join(member, "node")
    votes = judged.where("component IS NOT NULL").select("component", F.col("own.verdict").alias("own")).unionByName(targets.select("component", "own"))
    decided = votes.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    decided = decided.select("component", F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("shared"))
    out = judged.join(decided, "component", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "shared", F.lit("allow")).alias("verdict"), "component")


def oracle(rules: list[Rule] | None = None) -> str:
    """The same in DuckDB."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r))
    pick = lambda value, path="path": "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{value(r)}'" for r in ordered) + " ELSE NULL END"
    parse = lambda url: f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    parts = lambda rest: f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"
    clean = """CASE WHEN starts_with(path, '/') AND contains(path, '/.') THEN '/' || array_to_string(list_reduce(
    list_transform(string_split(substr(path, 2) || CASE WHEN regexp_matches(path, '/[.][.]?$') THEN '/' ELSE '' END, '/'), lambda s: [s]),
    lambda a, s: CASE s[1] WHEN '..' THEN a[:-2] WHEN '.' THEN a ELSE a || s END, []::VARCHAR[]), '/') ELSE path END"""
    key = lambda rest: f"host || CASE WHEN clean = '' THEN '/' ELSE clean END || regexp_extract({rest}, '^[^?#]*([?][^#]*)?', 1)"
    attribute = lambda tag, name: f"regexp_extract(regexp_extract(html, '(?i){tag}'), '(?i)\\b{name}\\s*=\\s*[\"'']?\\s*([^\"''>\\s]+)', 1)"
    canonical = attribute("<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>", "href")
    refresh = attribute("<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*>", "url")
    code = "coalesce(TRY_CAST('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+);', 1) AS INT), TRY_CAST(regexp_extract(p, '^&#([0-9]+);', 1) AS INT))"
    host = "regexp_extract(rest, '^([^/?#]*)', 1)"
    return f"""
WITH RECURSIVE p AS (SELECT *, {clean} AS clean FROM (SELECT page_id, html, rest, {parts('rest')} FROM (SELECT page_id, html, {parse("coalesce(url, '')")} AS rest FROM pages))),
n AS (SELECT *, CASE WHEN rest <> '' THEN {key('rest')} END AS node, {pick(lambda r: r.host + r.path)} AS rule, {pick(lambda r: r.verdict)} AS own FROM p),
t AS (SELECT node, rest, path, unnest([{canonical}, {refresh}]) AS raw FROM n WHERE node IS NOT NULL),
u AS (
  SELECT node, rest, path, array_to_string(list_transform(regexp_extract_all(raw, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|amp|lt|gt|quot|apos);|[^&]+|&'),
    lambda p: CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code})
      WHEN p = '&amp;' THEN '&' WHEN p = '&lt;' THEN '<' WHEN p = '&gt;' THEN '>' WHEN p = '&quot;' THEN '"' WHEN p = '&apos;' THEN chr(39) ELSE p END), '') AS url
  FROM t WHERE raw <> ''),
r AS (
  SELECT node, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {parse('url')} WHEN starts_with(url, '//') THEN substr(url, 3) WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(url, '/') THEN {host} || url WHEN starts_with(url, '?') THEN {host} || path || url WHEN starts_with(url, '#') THEN rest
    ELSE {host} || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END || url END AS rest FROM u),
e AS (SELECT node AS a, {key('rest')} AS b, {pick(lambda r: r.verdict, "clean")} AS own FROM (SELECT *, {clean} AS clean FROM (SELECT node, rest, {parts('rest')} FROM r WHERE rest IS NOT NULL))),
pairs AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM pairs UNION SELECT r.a, pairs.b FROM reach r JOIN pairs ON pairs.a = r.b),
member AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
votes AS (SELECT component, own FROM n JOIN member USING (node) UNION ALL SELECT component, own FROM e JOIN member ON member.node = e.b),
shared AS (SELECT component, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM votes GROUP BY component)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict, component
FROM n LEFT JOIN member USING (node) LEFT JOIN shared USING (component)"""
