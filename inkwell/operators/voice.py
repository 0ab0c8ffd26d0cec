"""Writing style by any grouping, and the texts made from it; all expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word, sentence and paragraph patterns, word lists and marks.
WORD = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)?"
SENTENCE = r"(?<=[.!?])(?:[\"')\]]*)\s+|\n+"
PARAGRAPH = r"\n\s*\n+"
CONTRACTION = r"(?i)(?<![\p{L}\p{N}_'])(?:[\p{L}\p{N}_]+(?:n't|'(?:d|ll|m|re|s|ve)))(?![\p{L}\p{N}_])"
FIRST_PERSON = ("i", "me", "my", "mine", "we", "us", "our", "ours")
SECOND_PERSON = ("you", "your", "yours", "yourself", "yourselves")
MARKS = {"em_dash": "—", "semicolon": ";", "colon": ":", "question": "?", "exclamation": "!", "parentheses": "(", "ellipsis": "…"}
LEAST_WORDS = 25


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def per_text(docs: DataFrame, *keys: str) -> DataFrame:
    """One row a text with its counts; sums over any grouping give the style."""
    t = F.trim(F.coalesce("text", F.lit("")))
    d = docs.select(*keys, t.alias("t")).filter("t <> ''").withColumn("w", words("t"))
    sizes = lambda part: F.filter(F.transform(part, lambda s: F.size(words(s))), lambda n: n > 0)
    d = d.withColumn("s", sizes(F.split("t", SENTENCE)))
    paragraphs = F.filter(F.split("t", PARAGRAPH), lambda p: p.rlike(WORD))
    d = d.withColumn("p", F.transform(paragraphs, lambda p: F.greatest(F.lit(1), F.size(sizes(F.split(p, SENTENCE))))))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n)
    low = F.transform("w", lambda x: F.replace(F.lower(x), F.lit("’"), F.lit("'")))
    out = {
        "n_words": F.size("w").cast("long"),
        "word_chars": total(F.transform("w", F.length)),
        "n_sentences": F.size("s").cast("long"),
        "sum_len": total("s"),
        "sum_sq": F.aggregate("s", F.lit(0).cast("long"), lambda a, n: a + n.cast("long") * n),
        "n_short": F.size(F.filter("s", lambda n: n <= 6)).cast("long"),
        "n_paragraphs": F.size("p").cast("long"),
        "paragraph_sentences": total("p"),
        "first_person": F.size(F.filter(low, lambda x: x.isin(*FIRST_PERSON))).cast("long"),
        "second_person": F.size(F.filter(low, lambda x: x.isin(*SECOND_PERSON))).cast("long"),
        "contractions": F.size(F.regexp_extract_all(F.replace("t", F.lit("’"), F.lit("'")), F.lit(CONTRACTION), 0)).cast("long"),
    }
    out |= {name: (F.length("t") - F.length(F.replace("t", F.lit(mark), F.lit("")))).cast("long") for name, mark in MARKS.items()}
    return d.select(*keys, *(c.alias(n) for n, c in out.items()))


def style(docs: DataFrame, key: str) -> DataFrame:
    """Style measures by key: one pass, partial sums map-side. Values are not rounded."""
    d = per_text(docs, key)
    s = {c: F.sum(c).alias(c) for c in d.columns if c != key}
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("n_texts"), *s.values()).filter(F.col("n_words") >= LEAST_WORDS)
    mean = F.col("sum_len") / F.col("n_sentences")
    rate = lambda c: F.col(c) * 1000.0 / F.col("n_words")
    return g.select(
        key, "n_texts", "n_words", "n_sentences", "n_paragraphs", mean.alias("mean_sentence_words"),
        F.sqrt(F.greatest(F.col("sum_sq") / F.col("n_sentences") - mean * mean, F.lit(0.0))).alias("sentence_stdev"),
        (F.col("n_short") / F.col("n_sentences")).alias("short_ratio"), (F.col("paragraph_sentences") / F.col("n_paragraphs")).alias("mean_paragraph_sentences"),
        (F.col("word_chars") / F.col("n_words")).alias("mean_word_chars"), rate("contractions").alias("contraction_rate"), rate("first_person").alias("first_rate"),
        rate("second_person").alias("second_rate"), *(rate(m).alias(f"{m}_rate") for m in MARKS),
    )


def type_token(docs: DataFrame, key: str) -> DataFrame:
    """key, n_words, n_types, ttr: exact distinct words."""
    w = docs.select(key, F.explode(words("text")).alias("w")).select(key, F.lower("w").alias("w")).groupBy(key, "w").count()
    return w.groupBy(key).agg(F.sum("count").alias("n_words"), F.count(F.lit(1)).alias("n_types")).withColumn("ttr", F.col("n_types") / F.col("n_words"))


def describe(styles: DataFrame) -> DataFrame:
    """styles with a description in words."""
    case = lambda c, a, b, x, y, z: F.when(F.col(c) < a, x).when(F.col(c) < b, y).otherwise(z)
    who = F.concat_ws(", and ", F.when(F.col("first_rate") >= 5, "uses first person naturally"), F.when(F.col("second_rate") >= 5, "addresses the reader directly"))
    marks = F.array_sort(F.filter(F.array(*(F.struct((-F.col(f"{m}_rate")).alias("r"), F.lit(m.replace("_", " ")).alias("m")) for m in sorted(MARKS))), lambda x: x["r"] <= -1.0))
    seen = F.array_join(F.slice(F.transform(marks, lambda x: x["m"]), 1, 3), ", ")
    text = F.format_string(
        "Sentences: %s, rhythm %s. Contractions: %s. The writer %s. Punctuation: %s.",
        case("mean_sentence_words", 10, 18, "mostly short", "mostly medium-length", "mostly long"),
        case("sentence_stdev", 4, 8, "fairly even", "moderately varied", "highly varied"),
        case("contraction_rate", 2, 10, "rare", "occasional", "frequent"),
        F.coalesce(F.nullif(who, F.lit("")), F.lit("avoids heavy personal address")),
        F.coalesce(F.nullif(seen, F.lit("")), F.lit("light")),
    )
    return styles.withColumn("description", text)


def sample(text: Column, most: int = 60_000) -> Column:
    """A long text's head, middle and tail."""
    part = most // 3
    n = F.length(text)
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), F.lit(part)), F.substring(text, (n / 2).cast("int") - part // 2 + 1, F.lit(part)), F.substring(text, n - part + 1, F.lit(part))))


def ngrams(text: Column, n: int) -> Column:
    """The distinct n-grams of lower-cased words. The words are bound once: a lambda's own expressions run for each element."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)
    gram = lambda w: lambda i: F.array_join(F.slice(w, i, n), " ")
    of = lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), gram(w))))
    return F.get(F.transform(F.array(words), of), F.lit(0))


def shared_ngrams(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, item_id, shared: documents that hold an item's n-grams. The join is on the n-gram's hash, verified by its words."""
    a = docs.select("doc_id", F.explode(ngrams(F.col("text"), n)).alias("g")).withColumn("h", F.xxhash64("g"))
    b = items.select("item_id", F.explode(ngrams(F.col("text"), n)).alias("g2")).withColumn("h", F.xxhash64("g2"))
    return a.join(b, "h").filter("g = g2").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


def valid_profile(rows: DataFrame, sample_col: str = "sample") -> DataFrame:
    """Profiles (name, description, sample) with ok: safe name, no digits, at most 20,000 characters, no 8-gram of the sample."""
    ok = F.col("name").rlike(r"^[a-z0-9][a-z0-9_-]{0,63}$") & ~F.col("description").rlike(r"\d") & (F.length("description") <= 20_000)
    return rows.withColumn("ok", ok & ~F.arrays_overlap(ngrams(F.col("description"), 8), ngrams(F.col(sample_col), 8)))
