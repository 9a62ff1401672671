"""Page operators: statistics, classes, headings, sections, selection.

Input `pages`: document_id, page_number, text. Regular expressions run where the page is read, so that only
narrow columns are exchanged; joins are on (document_id, page_number), which is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from ..session import materialise
from .ordered import top_k

HEADING_WINDOW = 2000
CONTINUATION_WINDOW = 8
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
MIN_SEGMENT = 200
PAGES_PER_PART = 200
LABEL_CONFIDENCE = 0.70
#: Weight of a rule label as a signal of its templates.
LABEL_WEIGHT = 0.2
#: Characters before a heading in its line, and lines a heading may take.
HEADING_INDENT, HEADING_LINES = 50, 4
# A text without any of these words cannot hit a statement heading.
_GATE = r"(?i)statement|sheet|account|flow|interests|equity"


def page_stats(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"word_count": X.word_count("text"), "ascii_ratio": X.ascii_ratio("text")})


def classify_pages(pages: DataFrame) -> DataFrame:
    """Digital, hybrid or scanned, decided on the unrounded ratio; scanned pages lose their text."""
    p = page_stats(pages).withColumn("classification", X.page_class("word_count", "ascii_ratio"))
    scanned = F.col("classification") == "scanned"
    return p.withColumns({"ascii_ratio": F.round("ascii_ratio", 4), "text": F.when(scanned, "").otherwise(F.col("text")),
                          "requires_ocr": scanned})


def page_summary(classified: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("classification") == k) for k in ("digital", "scanned", "hybrid")}
    return classified.groupBy("document_id").agg(
        *[v.alias(k) for k, v in n.items()], F.count(F.lit(1)).alias("total"),
        (n["scanned"] + n["hybrid"] > 0).alias("ocr_required"))


def _signals(kind: str):
    return [(i, *s) for i, s in enumerate(R.STATEMENT_SIGNALS) if s[1] == kind]


def _heading_window(pages: DataFrame, window: int | None) -> DataFrame:
    """Adds _head, the normalised text headings are looked for in; a column of its own so that it is computed once."""
    text = F.col("text") if window is None else F.left("text", F.lit(window))
    return pages.withColumn("_head", X.normalize_heading(text))


def statement_hits(head: str = "_head") -> Column:
    """First matching signal of each statement type, in signal order; [other] when nothing matches."""
    w = F.col(head)

    def first(kind: str) -> Column:
        return X._chain([(w.rlike(p), F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("statement_type"),
                                               F.lit(weight).alias("confidence"), F.regexp_extract(w, p, 0).alias("matched_text")))
                         for i, p, _, weight, _ in _signals(kind)])

    empty = F.lit(None).cast("struct<ord:int,statement_type:string,confidence:double,matched_text:string>")
    gated = [F.when(w.rlike(_GATE), first(k)).otherwise(empty) for k in R.STATEMENT_TYPES]
    hits = F.array_sort(F.array_compact(F.array(*gated, first("notes"))))
    other = F.array(F.struct(F.lit(len(R.STATEMENT_SIGNALS)).alias("ord"), F.lit("other").alias("statement_type"),
                             F.lit(1.0).alias("confidence"), F.lit("").alias("matched_text")))
    return F.when(F.size(hits) > 0, hits).otherwise(other)


def heading_types(head: str = "_head") -> Column:
    """Statement types with a heading anywhere in the text."""
    w = F.col(head)
    flags = [F.when(X.any_of([w.rlike(p) for _, p, *_ in _signals(k)]), F.lit(k)) for k in R.STATEMENT_TYPES]
    return F.when(w.rlike(_GATE), F.array_compact(F.array(*flags))).otherwise(F.array().cast("array<string>"))


def detect_statements(pages: DataFrame, window: int | None = HEADING_WINDOW) -> DataFrame:
    """One row per page and detected statement type."""
    p = _heading_window(pages, window)
    return p.select("document_id", "page_number", F.posexplode(statement_hits()).alias("rank", "hit")).select(
        "document_id", "page_number", (F.col("rank") + 1).alias("rank"), "hit.statement_type", "hit.confidence", "hit.matched_text")


def assign_sections(classified: DataFrame, window: int | None = HEADING_WINDOW) -> DataFrame:
    """First and second detected type of each page; scanned pages stay open."""
    keep = classified.columns
    p = _heading_window(classified, window).withColumn("_hits", F.when(F.col("classification") != "scanned", statement_hits()))
    first, second = F.try_element_at("_hits", F.lit(1)), F.try_element_at("_hits", F.lit(2))
    sections = F.struct(first["statement_type"].alias("section_type"), second["statement_type"].alias("secondary_section_type"),
                        first["matched_text"].alias("heading_verbatim"))
    # Through a generator, so that later filters on the section do not repeat the matching.
    return p.select(*keep, F.inline(F.array(sections)))


def reroute_hybrid(classified: DataFrame, min_drawings: int = 100, words_per_drawing: float = 0.5) -> DataFrame:
    """Digital pages that are mostly drawings are read as scans; `nominal_class` keeps the first class."""
    dense = (F.col("drawing_count") > min_drawings) & (F.col("word_count") < words_per_drawing * F.col("drawing_count"))
    return classified.withColumn("nominal_class", F.col("classification")).withColumn(
        "classification", F.when((F.col("classification") == "digital") & dense, "scanned").otherwise(F.col("classification")))


def group_sections(sectioned: DataFrame, with_secondary: bool = True) -> DataFrame:
    """Distinct (document, section, page) of the readable pages."""
    types = [F.col("section_type")] + ([F.col("secondary_section_type")] if with_secondary else [])
    return (sectioned.filter(F.col("classification") != "scanned")
            .select("document_id", F.explode(F.array_distinct(F.array_compact(F.array(*types)))).alias("section"), "page_number")
            .filter(F.col("section") != "other"))


def note_pages(sectioned: DataFrame) -> DataFrame:
    """Note number of each notes page, from its heading."""
    number = F.coalesce(F.nullif(F.regexp_extract("text", r"(?im)^note\s+(\d+)", 1), F.lit("")),
                        F.nullif(F.regexp_extract("text", r"(?m)^(\d+)\.\s+[A-Z]", 1), F.lit("")))
    is_note = (F.col("section_type") == "notes") | F.coalesce(F.col("secondary_section_type") == "notes", F.lit(False))
    return (sectioned.filter((F.col("classification") != "scanned") & is_note)
            .select("document_id", number.try_cast("int").alias("note_number"), "page_number").filter("note_number IS NOT NULL"))


def expand_continuation(sectioned: DataFrame, window: int = CONTINUATION_WINDOW, foreign_heading: bool = True) -> DataFrame:
    """Pages of each statement section including the unheaded pages that follow.

    Each detected page looks at most `window` pages ahead through an equi-join on the page number, so the
    work per page is bounded whatever the length of the document.
    """
    detected = group_sections(sectioned).filter(F.col("section") != "notes")
    heads = heading_types() if foreign_heading else F.array().cast("array<string>")
    stop = (F.col("classification") == "scanned") | F.coalesce(~F.col("section_type").isin("other", "notes"), F.lit(False))
    ahead = _heading_window(sectioned, None).select("document_id", "page_number", stop.alias("_stop"), heads.alias("_heads"))
    probes = (detected.withColumnRenamed("page_number", "start")
              .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(window))))
              .withColumn("page_number", F.col("start") + F.col("step")))
    foreign = F.exists(F.col("_heads"), lambda t: t != F.col("section"))
    blocked = F.coalesce(F.col("_stop") | foreign, F.lit(True))
    reach = (probes.join(ahead, ["document_id", "page_number"], "left").groupBy("document_id", "section", "start")
             .agg(F.min(F.when(blocked, F.col("step"))).alias("first_block")))
    last = F.coalesce(F.col("first_block"), F.lit(window + 1)) - 1
    return (reach.select("document_id", "section", F.explode(F.sequence(F.col("start"), F.col("start") + last)).alias("page_number"))
            .distinct())


def reduction_ratio(sectioned: DataFrame, selected: DataFrame) -> DataFrame:
    """Distinct selected pages over all pages of each document."""
    total = sectioned.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_pages"))
    chosen = selected.select("document_id", "page_number").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("selected_pages"))
    return total.join(chosen, "document_id", "left").select(
        "document_id", "total_pages", F.coalesce("selected_pages", F.lit(0)).alias("selected_pages"),
        F.round(F.coalesce("selected_pages", F.lit(0)) / F.col("total_pages"), 6).alias("reduction"))


def merge_page_labels(sectioned: DataFrame, labels: DataFrame, min_confidence: float = LABEL_CONFIDENCE) -> DataFrame:
    """Sections of scanned pages from a label table (document_id, page_number, statement_types, label_confidence).

    Labels below the confidence, and scanned pages without a label, count as other.
    """
    j = sectioned.join(labels, ["document_id", "page_number"], "left")
    sure = (F.col("label_confidence") >= min_confidence) & (F.size("statement_types") > 0)
    first = F.when(sure, F.try_element_at("statement_types", F.lit(1))).otherwise(F.lit("other"))
    second = F.when(sure, F.try_element_at("statement_types", F.lit(2)))
    scanned = F.col("classification") == "scanned"
    return (j.withColumns({"section_type": F.when(scanned, F.coalesce(first, F.lit("other"))).otherwise(F.col("section_type")),
                           "secondary_section_type": F.when(scanned, second).otherwise(F.col("secondary_section_type"))})
            .drop("statement_types", "label_confidence"))


def labelled_selection(merged: DataFrame) -> DataFrame:
    """Scanned pages a label put into a statement section."""
    return (merged.filter(F.col("classification") == "scanned")
            .select("document_id", F.explode(F.array_distinct(F.array_compact(F.array("section_type", "secondary_section_type"))))
                    .alias("section"), "page_number")
            .filter(~F.col("section").isin("other", "notes")))


def statement_scope(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """Scope of each section, read on its first selected page."""
    first = selected.groupBy("document_id", "section").agg(F.min("page_number").alias("page_number"))
    scopes = pages.select("document_id", "page_number", X.detect_scope("text").alias("scope"))
    return first.join(scopes, ["document_id", "page_number"], "left").select(
        "document_id", "section", "page_number", F.coalesce("scope", F.lit("unknown")).alias("scope"))


_STATEMENT_PATTERNS = [(p, t) for p, t, *_ in R.STATEMENT_SIGNALS if t != "notes"]
_HEADS = "array<struct<pos:int,statement_type:string>>"


def heading_lines(text: Column) -> Column:
    """(pos, statement_type) of the lines that begin with a statement heading, in order; positions count from 0.

    A heading starts within the first 50 characters of its line and may go on in the next three. Its lines are looked
    at once each; the text before a line is only counted, so that long pages take time in proportion.
    """
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    kind = lambda window: F.when(window.rlike(_GATE), X._chain([(window.rlike(rf"^[^\n]{{0,{HEADING_INDENT}}}?(?:{p})"), F.lit(t)) for p, t in _STATEMENT_PATTERNS]))
    mark = lambda lines: F.transform(lines, lambda line, i: F.struct((F.length(line) + 1).alias("size"), once(F.array_join(F.slice(lines, i + 1, HEADING_LINES), "\n"), kind).alias("kind")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_HEADS).alias("heads"))

    def step(done: Column, line: Column) -> Column:
        head = F.struct(done["pos"].alias("pos"), line["kind"].alias("statement_type"))
        return F.struct((done["pos"] + line["size"]).alias("pos"), F.when(line["kind"].isNotNull(), F.concat(done["heads"], F.array(head))).otherwise(done["heads"]).cast(_HEADS).alias("heads"))

    found = once(F.split(text, "\n"), lambda lines: F.aggregate(mark(lines), start, step, lambda done: done["heads"]))
    return F.when(text.rlike(_GATE), found).otherwise(F.array().cast(_HEADS))


def segment_pages(pages: DataFrame, section: str = "section") -> DataFrame:
    """Part of each page that belongs to the section named in column `section`."""
    text, target = F.col("text"), F.col(section)
    heads = F.struct(heading_lines(X.normalize_heading("text")).alias("h"))
    # Through a generator, so that the matching is not repeated wherever its result is used.
    p = pages.select("*", F.inline(F.array(heads)).alias("_heads"))
    own = F.filter("_heads", lambda h: h["statement_type"] == target)
    start = F.try_element_at(own, F.lit(1))["pos"]
    after = F.filter("_heads", lambda h: (h["statement_type"] != target) & (h["pos"] > start))
    end = F.coalesce(F.try_element_at(after, F.lit(1))["pos"], F.length(text))
    first = F.try_element_at("_heads", F.lit(1))["pos"]
    cut = F.when(start.isNotNull(), F.substring(text, start + 1, end - start)).otherwise(F.left(text, first))
    seg = F.when(F.size("_heads") == 0, text).when(F.length(cut) >= MIN_SEGMENT, cut).otherwise(F.lit(""))
    return p.withColumn("segment", seg).drop("_heads")


def section_text(pages: DataFrame, selected: DataFrame, max_chars: int | None = None,
                 pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Text of each section in page order, whole; sections longer than a part continue in the next part."""
    j = selected.join(pages.select("document_id", "page_number", "text"), ["document_id", "page_number"])
    part = F.floor((F.col("page_number") - 1) / pages_per_part).cast("int")
    body = F.expr(f"listagg(text, '{PAGE_BREAK}') WITHIN GROUP (ORDER BY page_number)".replace("\n", "\\n"))
    out = j.groupBy("document_id", "section", part.alias("part_no")).agg(F.count(F.lit(1)).alias("n_pages"), body.alias("text"))
    return out if max_chars is None else out.withColumn("text", F.left("text", F.lit(max_chars)))


def sample_labels(pages: DataFrame, selected: DataFrame, n_pages: int = 5, max_chars: int = 6000, n_labels: int = 30) -> DataFrame:
    """A sample of label-like lines from the first selected pages of each document."""
    chosen = top_k(selected.select("document_id", "page_number").distinct(), ["document_id"], [F.col("page_number")], n_pages)
    j = chosen.join(pages.select("document_id", "page_number", F.left("text", F.lit(max_chars)).alias("text")),
                    ["document_id", "page_number"])
    text = F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY page_number)")
    lines = F.transform(F.split(F.left("text", F.lit(max_chars)), "\n"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (F.length(x) >= 4) & (F.length(x) < 80) & ~x.rlike(r"^\d"))
    return (j.groupBy("document_id").agg(text.alias("text"))
            .select("document_id", F.posexplode(F.slice(good, 1, n_labels)).alias("label_no", "label"))
            .withColumn("label_no", F.col("label_no") + 1))


def label_phrases(rules: DataFrame) -> DataFrame:
    """(label, words, first, n, templates): rule labels by template, without those that every template has."""
    named = rules.filter(F.col("template_type").isNotNull() & (F.col("rule_label") != "")).select("template_type", F.col("rule_label").alias("label")).distinct()
    every = named.agg(F.count_distinct("template_type")).first()[0]
    words = F.split("label", " ")
    out = named.groupBy("label").agg(F.array_sort(F.collect_set("template_type")).alias("templates")).filter(F.size("templates") < every)
    return out.select("label", words.alias("words"), F.get(words, 0).alias("first"), F.size(words).alias("n"), "templates")


def label_hits(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(document_id, label, templates): labels found as runs of whole words on a document's pages, once each.

    The first word of a phrase tells how long the phrases are that it begins; only such runs are met, whole, by an
    equi-join. Where several phrases begin the longest counts: runs of a place with one length alone are decided at once.
    """
    phrases = materialise(phrases)
    lengths = materialise(phrases.groupBy("first").agg(F.array_sort(F.collect_set("n")).alias("_sizes")))
    most = phrases.agg(F.max("n")).first()[0] or 1
    tokens = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " ")), " ")
    # A page that comes more than once is decided by place over all its texts.
    key = [F.col("p.document_id").eqNullSafe(F.col("k.document_id")), F.col("p.page_number").eqNullSafe(F.col("k.page_number"))]
    again = pages.groupBy("document_id", "page_number").count().filter("count > 1")
    p = pages.select("document_id", "page_number", tokens.alias("_tokens")).alias("p").join(again.alias("k"), key[0] & key[1], "left").select("p.*", F.col("k.count").isNotNull().alias("_again"))
    places = F.transform("_tokens", lambda w, i: F.struct(i.alias("place"), F.slice("_tokens", i + 1, most).alias("run")))
    at = p.select("document_id", "page_number", "_again", F.inline(places)).withColumn("first", F.get("run", F.lit(0))).join(lengths, "first")
    at = at.withColumn("n", F.explode("_sizes")).filter(F.col("n") <= F.size("run"))
    at = at.select("document_id", "page_number", "place", "n", ((F.size("_sizes") == 1) & ~F.col("_again")).alias("_alone"), F.array_join(F.slice("run", F.lit(1), F.col("n")), " ").alias("label"))
    found = at.join(phrases.select("label", "n"), ["label", "n"])
    alone = found.filter("_alone").select("document_id", "label")
    longest = found.filter("NOT _alone").groupBy("document_id", "page_number", "place").agg(F.max_by("label", "n").alias("label"))
    hits = alone.unionByName(longest.select("document_id", "label")).distinct()
    return hits.join(phrases.select("label", "templates"), "label").select("document_id", "label", "templates")


def score_templates(pages: DataFrame, min_score: float = 0.6, rules: DataFrame | None = None) -> DataFrame:
    """Template of each document from the template hints of its headings, and with `rules` of the labels on its pages.

    Score = weight of the matched signals that hint at the template over the weight of all matched signals
    with hints; ties go to the lower template name. A label found is a signal of weight 0.2 that hints at the templates
    whose rules have it; labels of every template tell nothing.
    """
    w = F.col("_head")
    hinted = [(p, weight, hints) for p, _, weight, hints in R.STATEMENT_SIGNALS if hints]
    hit = F.array_compact(F.array(*[F.when(w.rlike(p), F.struct(F.lit(weight).alias("weight"), F.array(*map(F.lit, hints)).alias("hints")))
                                    for p, weight, hints in hinted]))
    hits = _heading_window(pages.filter(F.col("text").rlike(_GATE)), None).select("document_id", F.inline(hit))
    if rules is not None:
        hits = hits.unionByName(label_hits(pages, label_phrases(rules)).select("document_id", F.lit(LABEL_WEIGHT).alias("weight"), F.col("templates").alias("hints")))
    total = hits.groupBy("document_id").agg(F.sum("weight").alias("total_weight"))
    per = hits.select("document_id", "weight", F.explode("hints").alias("template")).groupBy("document_id", "template").agg(
        F.round(F.sum("weight"), 6).alias("weight"))
    best = per.groupBy("document_id").agg(
        F.max("weight").alias("weight"), F.min_by("template", F.struct(-F.col("weight"), F.col("template"))).alias("template"))
    scored = best.join(total, "document_id").withColumn("score", F.round(F.col("weight") / F.col("total_weight"), 6))
    docs = pages.select("document_id").distinct()
    return docs.join(scored, "document_id", "left").select(
        "document_id", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(F.col("score") >= min_score, F.col("template")).otherwise("T0_unknown").alias("template_type"))


def apply_classification(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Document attributes from a classification table; unknown companies and empty years change nothing."""
    n = found.select("document_id", *[F.col(c).alias(f"_{c}") for c in found.columns if c != "document_id"])
    j = documents.join(n, "document_id", "left")
    company = F.when(F.lower(F.trim("_company")) != "unknown", F.col("_company"))
    years = F.when(F.size("_report_years") > 0, F.col("_report_years"))
    return j.withColumns({
        "company": F.coalesce(company, F.col("company")), "report_years": F.coalesce(years, F.col("report_years")),
        "template_type": F.coalesce("_template_type", F.col("template_type")),
        "currency_code": F.coalesce("_currency_code", F.col("currency_code")),
        "unit_scale": F.coalesce("_unit_scale", F.col("unit_scale"))}).select(*documents.columns)
