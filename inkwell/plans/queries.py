"""The registered queries of the document operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import ucd
from inkwell.operators import diffs, fidelity, inspect, ledger, localize, metadata, operations, sanitize, search, select, structure, targeted, voice
from inkwell.plans import fixtures
from inkwell.session import table
from inkwell.streaming import stream

S = SparkSession


def _docs(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _marked(spark: S, d: str) -> DataFrame:
    return fixtures.inserted(_docs(spark, d))


# -- inspection ------------------------------------------------------------------------------------------------------


def doc_summary(spark: S, d: str) -> DataFrame:
    return inspect.summary(_docs(spark, d))


def line_offsets(spark: S, d: str) -> DataFrame:
    return structure.lines(_docs(spark, d))


def findings_rows(spark: S, d: str) -> DataFrame:
    return inspect.inspection(_marked(spark, d)).select("doc_id", "number", "offset", "codepoint", "kind", "severity", "removable", "replacement")


def findings_by_kind(spark: S, d: str) -> DataFrame:
    f = inspect.findings(_marked(spark, d))
    return f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("removable") & F.col("replacement").isNotNull()).alias("n_removable"))


def findings_by_policy(spark: S, d: str) -> DataFrame:
    """Kinds, severities and what may be changed under each policy that changes anything."""
    out = None
    for name in ("safe", "typographic", "aggressive"):
        f = inspect.findings(_marked(spark, d), inspect.UnicodePolicy(name=name)).withColumn("policy", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out.groupBy("policy", "kind", "severity", "removable", "replacement").agg(F.count(F.lit(1)).alias("n"))


def findings_rollup(spark: S, d: str) -> DataFrame:
    m = _marked(spark, d)
    f = inspect.findings(m).select("doc_id", "kind").join(m.select("doc_id", "source", "lang"), "doc_id")
    return f.rollup("source", "lang", "kind").agg(F.count(F.lit(1)).alias("n"))


def confusable_words(spark: S, d: str) -> DataFrame:
    return inspect.confusables(_marked(spark, d)).select("doc_id", "word", "char", "latin")


def doc_scripts(spark: S, d: str) -> DataFrame:
    return inspect.scripts(_marked(spark, d)).select("doc_id", F.array_join("scripts", ",").alias("scripts"))


def script_histogram(spark: S, d: str) -> DataFrame:
    return inspect.scripts(_marked(spark, d)).select(F.explode("scripts").alias("script")).groupBy("script").agg(F.count(F.lit(1)).alias("n_docs"))


_NOTABLE = ucd.notable_class()


def _findings_sql(extra: str = "", policy: str = "safe") -> str:
    """The verdicts under a policy, over one row per notable character."""
    rude, tidy = policy == "aggressive", policy in ("typographic", "aggressive")
    yes = lambda when: "true" if when else "false"
    put = lambda when, text: f"CAST('{text}' AS VARCHAR)" if when else "CAST(NULL AS VARCHAR)"
    calm = f"AND {yes(not rude)}"
    inc = lambda cps: "(" + ", ".join(map(str, cps)) + ")"
    has = lambda where, *s: f"regexp_matches({where}, '[{ucd.script_class(*s)}]')"
    rule = lambda k, sev, rem, rep="NULL": f"struct_pack(kind := '{k}', severity := '{sev}', removable := {rem}, replacement := {rep})"
    gone = "CAST('' AS VARCHAR)"
    no = "CAST(NULL AS VARCHAR)"
    rules = [
        (f"cp IN {inc(ucd.INVISIBLE)}", rule("zero_width", "suspicious", "true", gone)),
        (f"cp IN (8204, 8205) {calm} AND ((cp = 8205 AND emoji) OR {has('near12', *ucd.JOINING)})", rule("zero_width", "info", "false", no)),
        ("cp IN (8204, 8205)", rule("zero_width", "suspicious", "true", gone)),
        (f"cp IN {inc(ucd.BIDI_OVERRIDE)}", rule("bidi_control", "suspicious", yes(rude), put(rude, ""))),
        (f"cp IN {inc(ucd.BIDI)} {calm} AND {has('near40', *ucd.RIGHT_TO_LEFT)}", rule("bidi_control", "info", "false", no)),
        (f"cp IN {inc(ucd.BIDI)} AND NOT {has('near40', *ucd.RIGHT_TO_LEFT)}", rule("bidi_control", "suspicious", "true", gone)),
        (f"cp IN {inc(ucd.BIDI)}", rule("bidi_control", "notice", yes(rude), put(rude, ""))),
        (f"(cp BETWEEN 65024 AND 65039 OR cp BETWEEN 917760 AND 917999) {calm} AND (emoji OR {has('near12', 'Han', 'Hiragana', 'Katakana', 'Mongolian')})", rule("variation_selector", "info", "false", no)),
        ("cp BETWEEN 65024 AND 65039 OR cp BETWEEN 917760 AND 917999", rule("variation_selector", "suspicious", "true", gone)),
        ("cp BETWEEN 917504 AND 917631 AND regexp_matches(before, '\\x{1F3F4}[\\x{E0000}-\\x{E007F}]*$')", rule("tag_character", "info", "false", no)),
        ("cp BETWEEN 917504 AND 917631", rule("tag_character", "suspicious", "true", gone)),
        (f"cp = 847 AND {has('near12', *ucd.JOINING, *ucd.RIGHT_TO_LEFT)}", rule("zero_width", "info", "false", no)),
        ("cp = 847", rule("zero_width", "suspicious", "true", gone)),
        (f"cp BETWEEN 6155 AND 6157 {calm} AND {has('near12', 'Mongolian')}", rule("variation_selector", "info", "false", no)),
        ("cp BETWEEN 6155 AND 6157", rule("variation_selector", "suspicious", "true", gone)),
        (f"cp IN (6068, 6069) {calm} AND {has('near12', 'Khmer')}", rule("zero_width", "info", "false", no)),
        ("cp IN (6068, 6069)", rule("zero_width", "suspicious", "true", gone)),
        ("cp = 5760", rule("unusual_space", "notice", yes(tidy), put(tidy, " "))),
        ("cp = 173", rule("format", "notice", yes(tidy), put(tidy, ""))),
        (f"cp IN {inc(ucd.KEPT_SPACES)}", rule("non_breaking_space", "info", yes(rude), put(rude, " "))),
        (f"cp IN {inc(ucd.SPACES)}", rule("unusual_space", "notice", "true", "' '")),
        ("cp = 65533", rule("replacement_character", "suspicious", "false", no)),
        (f"regexp_matches(ch, '[{ucd.category_class('Co')}]')", rule("private_use", "suspicious", yes(rude), put(rude, ""))),
        (f"regexp_matches(ch, '[{ucd.category_class('Cc', chr(10) + chr(9) + chr(13))}]')", rule("control", "suspicious", "true", gone)),
        (f"regexp_matches(ch, '[{ucd.category_class('Cf')}]')", rule("format", "notice", yes(tidy), put(tidy, ""))),
    ]
    case = " ".join(f"WHEN {w} THEN {t}" for w, t in rules)
    around = lambda w: f"substr(text, greatest(o - {w}, 0) + 1, least(o, {w})) || substr(text, o + 2, {w})"
    return f"""marked AS ({fixtures.inserted_sql()}),
        chars AS (SELECT doc_id, source, lang, text, unnest(range(length(text))) AS o FROM marked WHERE regexp_matches(text, '[{_NOTABLE}]')),
        notable AS (SELECT *, substr(text, o + 1, 1) AS ch FROM chars WHERE regexp_matches(substr(text, o + 1, 1), '[{_NOTABLE}]')),
        seen AS (SELECT *, unicode(ch) AS cp, {around(12)} AS near12, {around(40)} AS near40, substr(text, 1, o) AS before,
                 regexp_matches({around(1)}, '[{ucd.emoji_class()}]') AS emoji FROM notable),
        judged AS (SELECT doc_id, source, lang, text, CAST(o AS INTEGER) AS "offset", cp AS codepoint, CASE {case} END AS v FROM seen),
        findings AS (SELECT doc_id, source, lang, text, "offset", codepoint, v.kind AS kind, v.severity AS severity, v.removable AS removable, v.replacement AS replacement FROM judged WHERE v IS NOT NULL){extra}"""


def _scripts_sql() -> str:
    held = ", ".join(f"CASE WHEN regexp_matches(text, '[{ucd.script_class(s)}]') THEN '{s}' END" for s in ucd.script_names())
    return f"marked AS ({fixtures.inserted_sql()}), scripts AS (SELECT doc_id, list_sort(list_filter([{held}], lambda s: s IS NOT NULL)) AS s FROM marked)"


# -- operations and sanitation ---------------------------------------------------------------------------------------


def sanitize_safe(spark: S, d: str) -> DataFrame:
    return sanitize.sanitize(_marked(spark, d)).select("doc_id", F.sha2("clean", 256).alias("sha256"), F.length("clean").alias("n_chars"), F.size("ops").alias("n_ops"), "edit_ratio")


def ops_apply(spark: S, d: str) -> DataFrame:
    m = _marked(spark, d)
    ops = operations.collect(sanitize.edits(m))
    r = m.join(ops, "doc_id").withColumn("clean", operations.apply("text", "ops"))
    return r.select("doc_id", F.sha2("clean", 256).alias("sha256"), operations.edit_ratio("text", "ops").alias("edit_ratio"), operations.length_drift("text", "clean").alias("drift"))


def ops_invert_roundtrip(spark: S, d: str) -> DataFrame:
    r = sanitize.sanitize(_marked(spark, d)).withColumn("back", operations.apply("clean", operations.invert("text", "ops")))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("back") == F.col("text")).alias("n_same"))


def ops_validate(spark: S, d: str) -> DataFrame:
    e = _docs(spark, d).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    start = F.when(F.col("i") == 3, F.length("text") + 1).otherwise(F.col("i") * 5)
    end = F.when(F.col("i") == 1, 12).when(F.col("i") == 3, F.length("text") + 2).otherwise(start + 2)
    rows = e.select("doc_id", "text", start.alias("start"), end.alias("end"), F.lit(None).cast("string").alias("original"), F.lit("~").alias("replacement"))
    return operations.violations(rows)


def sanitize_all_policies(spark: S, d: str) -> DataFrame:
    return sanitize.all_policies(_marked(spark, d)).groupBy("policy").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_ops").alias("n_ops"))


def span_counts(spark: S, d: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("long")
    return _marked(spark, d).groupBy("source").agg(*(F.sum(count(p)).alias(n) for n, p in SPAN_PATTERNS.items()))


#: Detectors that need no look-around, as both engines read them.
SPAN_PATTERNS = {
    "n_url": r"(?:https?|ftp|mailto):[^\s<>()\[\]{}\"`]+[^\s<>()\[\]{}\"`.,;:!?]",
    "n_email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+",
    "n_iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "n_percent": r"[0-9]+(?:[.,][0-9]+)*%",
    "n_bracket_citation": r"\[[0-9]{1,3}\]",
    "n_money": r"[$£€¥][0-9]+",
}


def spans_resolved(spark: S, d: str) -> DataFrame:
    return structure.spans(_marked(spark, d))


def span_anti_join(spark: S, d: str) -> DataFrame:
    m = _marked(spark, d)
    f = inspect.findings(m).withColumns({"start": F.col("offset"), "end": F.col("offset") + 1})
    return structure.outside_spans(f, structure.spans(m, locks=("Caf.", "k.k"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def blocked_findings(spark: S, d: str) -> DataFrame:
    m = _marked(spark, d)
    return sanitize.blocked(m, structure.spans(m, locks=("a.b", "k.k"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def md_blocks(spark: S, d: str) -> DataFrame:
    text = F.concat(F.lit("# Title\n\n"), F.col("text"), F.lit("\n\n- one\n- two\n  more\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n"))
    return structure.blocks(_docs(spark, d).withColumn("text", text), "text/markdown").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def plain_paragraphs(spark: S, d: str) -> DataFrame:
    text = F.regexp_replace("text", "\n", "\n\n")
    return structure.blocks(_docs(spark, d).withColumn("text", text)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))


# -- gates and selection ---------------------------------------------------------------------------------------------


def _edited(spark: S, d: str) -> DataFrame:
    """Three candidates a document: one character, a number changed, half of it gone.

    Documents are dealt to all tasks, before the texts are tripled: a file may be one row group.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    m = _marked(spark, d).select("doc_id", "text").repartition(tasks, "doc_id")
    op = lambda s, e, t: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(t).alias("text"))
    n = F.length("text")
    kinds = F.array(
        F.struct(F.lit("touch").alias("candidate_id"), F.array(op(F.lit(0), F.lit(1), "T")).alias("ops")),
        F.struct(F.lit("digit").alias("candidate_id"), F.array(op(F.greatest(F.locate("42%", F.col("text")) - 1, F.lit(1)), F.greatest(F.locate("42%", F.col("text")), F.lit(2)), "9")).alias("ops")),
        F.struct(F.lit("half").alias("candidate_id"), F.array(op(F.floor(n / 2), n, "")).alias("ops")),
    )
    rows = m.select("doc_id", "text", F.explode(kinds).alias("c")).select("doc_id", "text", "c.*")
    return rows.withColumn("regions", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))))


def gate_matrix(spark: S, d: str) -> DataFrame:
    return fidelity.gates(_edited(spark, d)).groupBy("candidate_id", "gate", "status").agg(F.count(F.lit(1)).alias("n"))


def gate_rejections(spark: S, d: str) -> DataFrame:
    r = fidelity.reports(fidelity.gates(_edited(spark, d)))
    return r.groupBy("candidate_id", F.split("rejection", ":")[0].alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def select_min_edit(spark: S, d: str) -> DataFrame:
    return select.best(fixtures.candidate_rows(_docs(spark, d))).select("doc_id", "candidate_id", "risk")


def skyline(spark: S, d: str) -> DataFrame:
    return select.skyline(fixtures.candidate_rows(_docs(spark, d))).select("doc_id", "candidate_id")


def topk_regions(spark: S, d: str) -> DataFrame:
    return select.top_k(fixtures.candidate_rows(_docs(spark, d)), "doc_id", [F.desc("risk"), F.col("idx")], 3).select("doc_id", "candidate_id", "rank")


def dedup_by_hash(spark: S, d: str) -> DataFrame:
    return select.first_of_hash(fixtures.candidate_rows(_docs(spark, d)), ["doc_id", "content_hash"], [F.col("idx")]).select("doc_id", "candidate_id")


def diverse_beam(spark: S, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.col("text").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("place"))
    text = F.when(F.col("place") % 2 == 0, F.col("t")).otherwise(F.concat(F.reverse("t"), F.col("place").cast("string")))
    return select.diverse_beam(rows.select("doc_id", "place", text.alias("text")), 3).select("doc_id", "place")


def token_windows(spark: S, d: str) -> DataFrame:
    return localize.windows_of(_docs(spark, d), 64, 32)


def _risk(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("(?:th|en|la)"), 0)).cast("double")


def window_risk(spark: S, d: str) -> DataFrame:
    return localize.ranked(localize.windows_of(_docs(spark, d), 64, 32, _risk), 3).select("doc_id", "start", "end", "risk", "rank")


def regions_clipped(spark: S, d: str) -> DataFrame:
    m = _marked(spark, d)
    regions = m.select("doc_id", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(1.0).alias("risk"))
    return localize.clip(regions, structure.spans(m))


def regions_merged(spark: S, d: str) -> DataFrame:
    w = localize.windows_of(_docs(spark, d), 40, 21)
    return localize.merged(w.select("doc_id", "start", "end", (F.col("window") % 7).cast("double").alias("risk")))


def windows_clipped(spark: S, d: str) -> DataFrame:
    """Token windows minus pairs of tokens that begin with a capital; such pairs overlap."""
    docs = _docs(spark, d)
    w = localize.windows_of(docs, 64, 32).select("doc_id", "start", "end", F.col("window").cast("double").alias("risk"))
    pair = lambda p: F.transform(p["starts"], lambda a, i: F.struct(a.alias("start"), F.coalesce(F.get(p["ends"], i + 1), F.get(p["ends"], i)).alias("end"), F.get(p["firsts"], i).alias("first")))
    pairs = docs.select("doc_id", structure.places("text").alias("p")).select("doc_id", F.explode(F.filter(pair(F.col("p")), lambda x: x["first"].between(ord("A"), ord("Z")))).alias("x"))
    return localize.clip(w, pairs.select("doc_id", "x.start", "x.end"))


def edits_located(spark: S, d: str) -> DataFrame:
    """Where the edits of a clean-up, and an insertion behind each, stand: their line, whether a word holds them, and the region that they may change."""
    m = _marked(spark, d)
    places = lambda rows, name: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    edits = sanitize.edits(m).select("doc_id", "start", "end")
    both = edits.unionByName(edits.select("doc_id", F.col("end").alias("start"), "end"))
    words = F.transform("p.starts", lambda a, i: F.struct(a.alias("start"), F.get(F.col("p.ends"), i).alias("end"))).alias("words")
    held = m.filter(F.col("text").rlike(ucd.notable_pattern())).select("doc_id", F.length("text").alias("n"), structure.places("text").alias("p")).select("doc_id", "n", words)
    rows = held.join(places(both, "ops"), "doc_id").join(places(structure.lines(m), "lines"), "doc_id", "left")
    each = rows.select("doc_id", "lines", "words", F.explode(F.arrays_zip("ops", localize.editable_regions(F.col("ops"), F.col("n")).alias("region"))).alias("o"))
    start, end = F.col("o.ops.start"), F.col("o.ops.end")
    return each.select("doc_id", start.alias("start"), end.alias("end"), localize.span_index(F.col("lines"), start).alias("line"), localize.is_protected(F.col("words"), start, end).alias("in_word"), F.col("o.region.start").alias("region_start"), F.col("o.region.end").alias("region_end"))


# -- style and n-grams -----------------------------------------------------------------------------------------------

_STYLE = ["n_texts", "n_words", "n_sentences", "n_paragraphs", "mean_sentence_words", "short_ratio", "mean_word_chars"]


def voice_by_source(spark: S, d: str) -> DataFrame:
    return voice.style(_docs(spark, d), "source").select("source", *_STYLE, "semicolon_rate", "exclamation_rate")


def voice_by_lang(spark: S, d: str) -> DataFrame:
    return voice.describe(voice.style(_docs(spark, d), "lang")).select("lang", "n_words", "sentence_stdev", "contraction_rate", "first_rate", "description")


def ttr_by_lang(spark: S, d: str) -> DataFrame:
    return voice.type_token(_docs(spark, d), "lang")


def turn_bigram_divergence(spark: S, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).filter("before is not null")
    return c.select("conv_id", "turn", select.bigram_divergence("before", "text").alias("divergence"))


def benchmark_8gram_overlap(spark: S, d: str) -> DataFrame:
    return voice.shared_ngrams(_docs(spark, d), table(spark, d, "benchmark"), 8)


# -- metadata --------------------------------------------------------------------------------------------------------


def _tagged(spark: S, d: str) -> DataFrame:
    """pages with metadata put after <head>."""
    p = table(spark, d, "pages")
    tag = F.when(F.col("page_id") % 4 == 0, '<meta name="generator" content="Site 1">').when(F.col("page_id") % 4 == 1, '<meta name="x" content="Made with ChatGPT">').when(
        F.col("page_id") % 4 == 2, "<script type=\"application/ld+json\">{\"digitalSource\": 1}</script>"
    )
    return p.withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), F.coalesce(tag, F.lit("")))))


_TAGGED = """SELECT page_id, replace(html, '<head>', '<head>' || CASE page_id % 4 WHEN 0 THEN '<meta name="generator" content="Site 1">' WHEN 1 THEN '<meta name="x" content="Made with ChatGPT">'
    WHEN 2 THEN '<script type="application/ld+json">{"digitalSource": 1}</script>' ELSE '' END) AS html FROM pages"""


def html_meta_evidence(spark: S, d: str) -> DataFrame:
    return metadata.html_evidence(_tagged(spark, d))


def html_clean(spark: S, d: str) -> DataFrame:
    return metadata.clean_html(_tagged(spark, d)).select("page_id", F.sha2("clean", 256).alias("sha256"))


def evidence_state(spark: S, d: str) -> DataFrame:
    p = _tagged(spark, d)
    return metadata.state(metadata.html_evidence(p), p, "page_id")


def _fronted(spark: S, d: str) -> DataFrame:
    line = F.when(F.col("doc_id") % 3 == 0, "author: Ann\ntopic: x").when(F.col("doc_id") % 3 == 1, "tool: Claude\nCreation-Date: 1").otherwise("topic: y")
    return _docs(spark, d).withColumn("text", F.concat(F.lit("---\n"), line, F.lit("\n---\n"), "text"))


_FRONTED = """SELECT doc_id, text AS body, CASE doc_id % 3 WHEN 0 THEN ['author: Ann', 'topic: x'] WHEN 1 THEN ['tool: Claude', 'Creation-Date: 1'] ELSE ['topic: y'] END AS front FROM documents"""


def frontmatter_lines(spark: S, d: str) -> DataFrame:
    return metadata.front_lines(_fronted(spark, d)).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


def frontmatter_clean(spark: S, d: str) -> DataFrame:
    return metadata.clean_front(_fronted(spark, d)).select("doc_id", F.sha2("clean", 256).alias("sha256"))


# -- ledgers, outcomes, search ---------------------------------------------------------------------------------------


def budget_admission(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cost", F.round(F.abs("value")).cast("long"))
    return ledger.admit(e, "user_id", ["ts", "event_id"], "cost", 200).select("event_id", "spent", "admitted")


def lease_ledger(spark: S, d: str) -> DataFrame:
    """Every user's events as two leases at a time: both reserved, the first settled and closed, the second closed unsettled."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, d, "events").withColumns({"k": place, "amount": F.round(F.abs("value")).cast("long")})
    action = F.get(F.array(*(F.lit(a) for a in ("reserve", "reserve", "settle", "close", "close"))), F.col("k") % 5)
    lease = F.floor(F.col("k") / 5) * 2 + F.when((F.col("k") % 5).isin(1, 4), 1).otherwise(0)
    r = ledger.leases(e.select("event_id", "user_id", "k", action.alias("action"), lease.alias("lease"), "amount"), "user_id", ["k"], 300)
    return r.select("event_id", "outcome", "spent", "reserved", "remaining")


def event_sequence(spark: S, d: str) -> DataFrame:
    return ledger.sequence(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "sequence")


def event_rates(spark: S, d: str) -> DataFrame:
    r = stream.rates(table(spark, d, "events"))
    return r.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def rejection_tally(spark: S, d: str) -> DataFrame:
    c = fixtures.candidate_rows(_docs(spark, d))
    why = F.when(~F.col("valid"), "fidelity").when(~F.col("target_met"), "target").otherwise("none")
    return c.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("risk").alias("best_risk"))


def candidate_ids(spark: S, d: str) -> DataFrame:
    return fixtures.candidate_rows(_docs(spark, d)).select("doc_id", "idx", select.candidate_id("candidate_id", "content_hash").alias("id"))


def stagnation(spark: S, d: str) -> DataFrame:
    r = fixtures.candidate_rows(_docs(spark, d)).select("doc_id", F.col("idx").alias("round"), "risk")
    return ledger.stagnation(r)


def detection_metrics(spark: S, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "lang", F.col("text").contains("idiot").alias("predicted")), "doc_id")
    return ledger.detection_metrics(j.withColumn("truth", F.col("toxic") == 1), "lang")


def before_after_flip(spark: S, d: str) -> DataFrame:
    docs = _docs(spark, d)
    z = lambda k: ((F.col("doc_id") * k) % 16).cast("double") / 4.0
    side = lambda k: docs.select(F.col("doc_id").alias("id"), (z(k) > 2.0).alias("detected"), z(k).alias("z"))
    return ledger.flips(side(7), side(5))


def provider_separation(spark: S, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("Claude", "openai/gpt", "Ollama", "meta_llama", "mistral")))
    rows = table(spark, d, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("source_provider"), F.get(names, (F.col("c_custkey") % 3).cast("int")).alias("rewrite_provider"))
    return ledger.separated(rows).select("c_custkey", ledger.provider(F.col("source_provider")).alias("source"), ledger.provider(F.col("rewrite_provider")).alias("rewrite"))


def config_precedence(spark: S, d: str) -> DataFrame:
    layers = F.array(*(F.lit(x) for x in ledger.LAYERS))
    rows = table(spark, d, "orders").select(F.concat(F.lit("k"), (F.col("o_orderkey") % 50).cast("string")).alias("key"), F.get(layers, (F.col("o_orderkey") % 7 % 6).cast("int")).alias("layer"))
    return ledger.precedence(rows.groupBy("key", "layer").agg(F.count(F.lit(1)).alias("value"))).select("key", "value", "layer")


def target_states(spark: S, d: str) -> DataFrame:
    modes = F.array(*(F.lit(m) for m in ("verify_below_threshold", "relative_reduction", "minimize_surrogate", "stress_test")))
    c = fixtures.candidate_rows(_docs(spark, d)).withColumns({"mode": F.get(modes, (F.col("doc_id") % 4).cast("int")), "kind": F.when(F.col("idx") % 2 == 0, "surrogate").otherwise("named")})
    met = ledger.target_met(F.col("mode"), F.col("kind"), F.lit(0.75), F.col("risk"), F.lit(0.5), F.lit(0.125))
    return c.withColumn("met", met).groupBy("mode", "kind", "met").agg(F.count(F.lit(1)).alias("n"))


_PHRASES = [("the ", "a "), ("der ", "die "), ("de ", "du "), (", ", "; ")]


def _options(docs: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.instr("text", a) > 0, F.struct((F.instr("text", a) - 1).alias("start"), (F.instr("text", a) - 1 + len(a)).alias("end"), F.lit(b).alias("replacement"))) for a, b in _PHRASES)))
    return docs.select("doc_id", F.explode(found).alias("o")).select("doc_id", "o.*")


def one_shot_select(spark: S, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return search.one_shot(docs, _options(docs), _risk, 50.0).select("doc_id", F.sha2("result", 256).alias("sha256"), "risk", "target_met")


def recursive_rollback(spark: S, d: str) -> DataFrame:
    """Three hops, each with a style of its own; the second and later ones start from the best text so far."""
    step = lambda _, hop: F.replace("text", F.lit(("th", "en", "la")[hop - 1]), F.lit(("x", "thth", "y")[hop - 1]))
    return search.hops(_docs(spark, d), step, _risk, patience=2, threshold=2.0).select("doc_id", "hop", "risk", "baseline", "hops_run", "met", "reason")


def minimal_edits(spark: S, d: str) -> DataFrame:
    """The shortest edits from every text to what a clean-up makes of it, carried out again."""
    r = diffs.edited(sanitize.sanitize(_marked(spark, d)).select("doc_id", F.col("text").alias("before"), F.col("clean").alias("after")))
    r = r.withColumn("again", operations.apply("before", "ops"))
    return r.select("doc_id", F.sha2("again", 256).alias("sha256"), (F.size("ops") > 0).alias("changed"))


_COMPLETIONS = (
    None, "prose", '["a"]', '{"replacement": "x"}', '{"replacement": "", "operator": "sentence_rewrite"}', None, '{"replacement": "x", "operator": "delete"}', '{"replacement": "x", "operator": "sentence_rewrite", "extra": 1}',
)


def structured_proposals(spark: S, d: str) -> DataFrame:
    """Four completions for the start of every document, by the rules of structured proposals."""
    rows = _docs(spark, d).select("doc_id", F.substring("text", 1, 20).alias("phrase"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    kind = F.when(F.col("place") == 3, F.col("doc_id") % 8).otherwise((F.col("doc_id") + F.col("place")) % 8).cast("int")
    made = lambda text: F.to_json(F.struct(text.alias("replacement"), F.lit("sentence_rewrite").alias("operator")))
    said = F.when(kind == 0, made(F.concat(F.lit("x"), "phrase"))).when(kind == 5, made(F.col("phrase"))).otherwise(F.get(F.array(*(F.lit(c) for c in _COMPLETIONS)), kind))
    c = rows.select("doc_id", F.lit(0).alias("region"), "place", "phrase", said.alias("completion"))
    return search.structured(c, ("sentence_rewrite", "short_span_rewrite"), 2).select("doc_id", "place", "refusal", "rank", F.sha2("replacement", 256).alias("sha256"))


def beam_depths(spark: S, d: str) -> DataFrame:
    return search.beam(_docs(spark, d), _PHRASES, _risk).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.min("risk").alias("best"))


def _phrase_options(phrase: Column) -> Column:
    made = [F.when(F.instr(phrase, a) > 0, F.struct(F.concat(F.substring(phrase, F.lit(1), F.instr(phrase, a) - 1), F.lit(b), F.substring(phrase, F.instr(phrase, a) + len(a), F.length(phrase))).alias("replacement"), F.lit("exact_phrase").alias("operator"))) for a, b in _PHRASES]
    return F.array_compact(F.array(*made))


def targeted_search(spark: S, d: str) -> DataFrame:
    """A gated beam over each document's riskiest windows, until three marks of the scorer are gone."""
    docs = _docs(spark, d)
    regions = targeted.window_regions(docs, "text/plain", _risk, 24, 12, 5)
    s = targeted.Settings(mode="relative_reduction", least_gain=3.0, limits=(0.5, 0.5, 0.1), width=4, scorer="marks/1")
    return targeted.search(regions, _phrase_options, _risk, s).drop("refused").withColumn("result", F.sha2("result", 256))


def targeted_outcomes(spark: S, d: str) -> DataFrame:
    """Why searches end, at which depth, and what gates refused on the way."""
    docs = _docs(spark, d)
    regions = targeted.window_regions(docs, "text/plain", _risk, 24, 12, 5)
    s = targeted.Settings(mode="relative_reduction", least_gain=9.0, limits=(0.3, 0.3, 0.05), width=2, max_candidates=12, scorer="marks/1")
    r = targeted.search(regions, _phrase_options, _risk, s)
    return r.groupBy("state", "reason", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("scored").alias("scored"), F.sum(F.size("refused")).alias("refused"), F.sum("duplicates").alias("duplicates"))


def proposals(spark: S, d: str) -> DataFrame:
    rows = ["However,", "Although it rained, we went out.", "one; two", "a — b", "It ended. However, we stayed.", "nothing"]
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.get(F.array(*(F.lit(r) for r in rows)), (F.col("n_nationkey") % len(rows)).cast("int")).alias("phrase"))
    return search.proposals(p)


QUERIES = {
    f.__name__: f
    for f in (
        doc_summary, line_offsets, findings_rows, findings_by_kind, findings_by_policy, findings_rollup, confusable_words, doc_scripts, script_histogram, sanitize_safe, ops_apply, ops_invert_roundtrip,
        ops_validate, sanitize_all_policies, span_counts, spans_resolved, span_anti_join, blocked_findings, md_blocks, plain_paragraphs, gate_matrix, gate_rejections, select_min_edit,
        skyline, topk_regions, dedup_by_hash, diverse_beam, token_windows, window_risk, regions_clipped, regions_merged, windows_clipped, edits_located, voice_by_source, voice_by_lang, ttr_by_lang, turn_bigram_divergence,
        benchmark_8gram_overlap, html_meta_evidence, html_clean, evidence_state, frontmatter_lines, frontmatter_clean, budget_admission, lease_ledger,
        event_sequence, event_rates, rejection_tally, candidate_ids, stagnation, detection_metrics, before_after_flip, provider_separation, config_precedence, target_states, one_shot_select, recursive_rollback, beam_depths, minimal_edits, structured_proposals, targeted_search, targeted_outcomes, proposals,
    )
}
