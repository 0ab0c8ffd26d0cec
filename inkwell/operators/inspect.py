"""Hidden and unusual characters: findings with script-aware verdicts.

A document with nothing notable costs one regular expression; the others are
cut at each notable code point, and only these are classified. Context
(emoji neighbours, scripts within 12 or 40 code points) comes from the block of
512 code points that a notable one stands in and the ends of its neighbours, so
no verdict walks the text from its start, and no window or shuffle is needed.
Only texts that hold a homoglyph reach Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import ucd


@dataclass(frozen=True)
class UnicodePolicy:
    """What a clean-up may change: report, safe, typographic or aggressive."""

    name: str = "safe"
    preserve_emoji_sequences: bool = True
    preserve_language_controls: bool = True
    normalize_spaces: bool = True
    normalization_form: str = "NFC"

    def __post_init__(self) -> None:
        if self.name not in ("report", "safe", "typographic", "aggressive"):
            raise ValueError(f"unknown policy {self.name}")
        if self.normalization_form not in ("none", "NFC", "NFKC"):
            raise ValueError(f"unknown form {self.normalization_form}")

    @property
    def mutates(self) -> bool:
        return self.name != "report"

    @property
    def aggressive(self) -> bool:
        return self.name == "aggressive"


#: Code points of a block, and how many on either side a verdict may read.
BLOCK, NEAR = 512, 40
#: Stands for a tag character of a flag sequence; no character has this code.
_OF_FLAG = "\U0010ffff"
CARRIER = "struct<offset:int,char:string,left:string,right:string,of_flag:boolean>"


def verdict(carrier: Column, policy: UnicodePolicy) -> Column:
    """struct(kind, severity, removable, replacement, protected_by) of a carrier, or null; the first rule that fits wins."""
    char, left, right = carrier["char"], carrier["left"], carrier["right"]
    cp = F.ascii(char)
    near = F.concat(_end(left, 12), F.substring(right, 1, 12))
    beside = F.concat(_end(left, 1), F.substring(right, 1, 1))
    wide = F.concat(left, right)
    emoji = beside.rlike(f"[{ucd.emoji_class()}]")
    has = lambda where, *scripts: where.rlike(f"[{ucd.script_class(*scripts)}]")
    rude, tidy = F.lit(policy.aggressive), F.lit(policy.name in ("typographic", "aggressive"))
    language = F.lit(policy.preserve_language_controls)

    def is_(kind: str, severity: str, removable, replacement: str | None, protected: str | None = None) -> Column:
        removable = F.lit(removable) if isinstance(removable, bool) else removable
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(severity).alias("severity"),
            removable.alias("removable"),
            F.when(removable, F.lit(replacement)).alias("replacement"),
            F.when(~removable, F.lit(protected)).alias("protected_by"),
        )

    joiner_kept = ((cp == 0x200D) & emoji & F.lit(policy.preserve_emoji_sequences)) | (has(near, *ucd.JOINING) & language)
    rtl = has(wide, *ucd.RIGHT_TO_LEFT)
    flag = carrier["of_flag"]
    rules = [
        (cp.isin(*ucd.INVISIBLE), is_("zero_width", "suspicious", True, "")),
        (cp.isin(0x200C, 0x200D) & joiner_kept & ~rude, is_("zero_width", "info", False, None, "joining_context")),
        (cp.isin(0x200C, 0x200D), is_("zero_width", "suspicious", True, "")),
        (cp.isin(*ucd.BIDI_OVERRIDE), is_("bidi_control", "suspicious", policy.aggressive, "", "requires_research_mode")),
        (cp.isin(*ucd.BIDI) & rtl & language & ~rude, is_("bidi_control", "info", False, None, "rtl_context")),
        (cp.isin(*ucd.BIDI) & ~rtl, is_("bidi_control", "suspicious", True, "")),
        (cp.isin(*ucd.BIDI), is_("bidi_control", "notice", policy.aggressive, "", "requires_research_mode")),
        (
            (cp.between(0xFE00, 0xFE0F) | cp.between(0xE0100, 0xE01EF)) & ((emoji & F.lit(policy.preserve_emoji_sequences)) | has(near, "Han", "Hiragana", "Katakana", "Mongolian")) & ~rude,
            is_("variation_selector", "info", False, None, "variation_context"),
        ),
        (cp.between(0xFE00, 0xFE0F) | cp.between(0xE0100, 0xE01EF), is_("variation_selector", "suspicious", True, "")),
        (cp.between(0xE0000, 0xE007F) & flag & F.lit(policy.preserve_emoji_sequences), is_("tag_character", "info", False, None, "emoji_tag_sequence")),
        (cp.between(0xE0000, 0xE007F), is_("tag_character", "suspicious", True, "")),
        ((cp == 0x034F) & has(near, *ucd.JOINING, *ucd.RIGHT_TO_LEFT) & language, is_("zero_width", "info", False, None, "joining_context")),
        (cp == 0x034F, is_("zero_width", "suspicious", True, "")),
        (cp.between(0x180B, 0x180D) & has(near, "Mongolian") & language & ~rude, is_("variation_selector", "info", False, None, "mongolian_context")),
        (cp.between(0x180B, 0x180D), is_("variation_selector", "suspicious", True, "")),
        (cp.isin(0x17B4, 0x17B5) & has(near, "Khmer") & language & ~rude, is_("zero_width", "info", False, None, "khmer_context")),
        (cp.isin(0x17B4, 0x17B5), is_("zero_width", "suspicious", True, "")),
        (cp == 0x1680, is_("unusual_space", "notice", tidy & F.lit(policy.normalize_spaces), " ", "script_space")),
        (cp == 0xAD, is_("format", "notice", tidy, "", "typography")),
        (cp.isin(*ucd.KEPT_SPACES), is_("non_breaking_space", "info", policy.aggressive, " ", "typography")),
        (cp.isin(*ucd.SPACES), is_("unusual_space", "notice", policy.mutates and policy.normalize_spaces, " ", "policy")),
        (cp == 0xFFFD, is_("replacement_character", "suspicious", False, None, "unrecoverable")),
        (ucd.is_in(char, ucd.category_class("Co")), is_("private_use", "suspicious", policy.aggressive, "", "requires_research_mode")),
        (ucd.is_in(char, ucd.category_class("Cc", "\n\t\r")), is_("control", "suspicious", True, "")),
        (ucd.is_in(char, ucd.category_class("Cf")), is_("format", "notice", tidy, "", "policy")),
    ]
    out = None
    for when, then in rules:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out


def _end(x: Column, n: int) -> Column:
    return F.substring(x, F.greatest(F.length(x) - n, F.lit(0)) + 1, F.lit(n))


def blocks(text: Column) -> Column:
    """The text in pieces of 512 code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def carriers(text: Column) -> Column:
    """The notable code points of a text in their order: array of struct(offset, char, left, right, of_flag).

    left and right: up to ``NEAR`` code points before and behind it. of_flag: a
    tag character that only tag characters part from a black flag. The text goes by
    blocks, each with the ends of its neighbours; a block without a notable
    code point costs one regular expression.
    """
    one = f"(?:{_OF_FLAG}|{ucd.notable_pattern()})"
    none = F.array().cast(f"array<{CARRIER}>")
    tag = "[\\x{E0000}-\\x{E007F}]"
    # each match begins at a flag or where the one before ended, so a run of tags is walked once
    told = F.when(text.contains("\U0001f3f4"), F.regexp_replace(text, f"(\\x{{1F3F4}}|(?!^)\\G){tag}", f"$1{_OF_FLAG}")).otherwise(text)

    def step(seen, piece):  # a carrier stands behind each piece but the last
        return F.concat(seen, F.array(F.coalesce(F.try_element_at(seen, F.lit(-1)) + 1, F.lit(0)) + F.length(piece)))

    def of_block(bound, k):
        block, seen = F.get(bound["whole"], k), F.get(bound["told"], k)
        sides = F.struct(block.alias("block"), seen.alias("seen"), F.coalesce(_end(F.get(bound["whole"], k - 1), NEAR), F.lit("")).alias("before"), F.coalesce(F.substring(F.get(bound["whole"], k + 1), 1, NEAR), F.lit("")).alias("behind"))

        def found(x):
            places = F.transform(F.array(F.split(x["seen"], one, -1)), lambda p: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), F.array().cast("array<int>"), step))
            own = lambda at: F.substring(x["block"], at + 1, F.lit(1))
            return F.transform(
                F.get(places, F.lit(0)),
                lambda at: F.struct(
                    (at + k * BLOCK).alias("offset"), own(at).alias("char"), _end(F.concat(x["before"], F.substring(x["block"], F.lit(1), at)), NEAR).alias("left"),
                    F.substring(F.concat(F.substring(x["block"], at + 2, F.lit(NEAR)), x["behind"]), 1, NEAR).alias("right"),
                    ((F.substring(x["seen"], at + 1, F.lit(1)) == _OF_FLAG) & own(at).rlike(f"^{tag}$")).alias("of_flag"),
                ),
            )

        return F.when(seen.rlike(one), F.get(F.transform(F.array(sides), found), F.lit(0))).otherwise(none)

    both = F.array(F.struct(blocks(text).alias("whole"), blocks(told).alias("told")))
    every = F.transform(both, lambda bound: F.flatten(F.transform(bound["whole"], lambda _, k: of_block(bound, k))))
    kept = F.filter(F.get(every, F.lit(0)), lambda c: c["char"].rlike(ucd.notable_pattern()))
    return F.when(text.rlike(ucd.notable_pattern()), kept).otherwise(none)


def findings(docs: DataFrame, policy: UnicodePolicy | None = None) -> DataFrame:
    """doc_id, offset, codepoint, char, kind, severity, removable, replacement, protected_by (carriers; not confusables)."""
    policy = policy or UnicodePolicy()
    some = docs.filter(F.col("text").rlike(ucd.notable_pattern())).select("doc_id", F.explode(carriers(F.col("text"))).alias("c"))
    judged = some.withColumn("v", verdict(F.col("c"), policy))
    return judged.filter("v is not null").select("doc_id", "c.offset", F.ascii("c.char").alias("codepoint"), "c.char", "v.*")


_WORD = re.compile(r"\w+")
_GLYPHS = "".join(ucd.CONFUSABLE)


def homoglyphs(text: str) -> list[tuple[int, str, str]]:
    """(offset, char, word) of the confusable characters in words that hold a Latin letter."""
    out = []
    for m in _WORD.finditer(text):
        word = m[0]
        if len(word) > 1 and not word.isascii() and any("a" <= c.lower() <= "z" for c in word):
            out += [(m.start() + i, c, word) for i, c in enumerate(word) if c in ucd.CONFUSABLE]
    return out


def _homoglyphs():
    kind = pa.list_(pa.struct([("offset", pa.int32()), ("char", pa.string()), ("word", pa.string())]))

    @F.arrow_udf("array<struct<offset:int,char:string,word:string>>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [dict(zip(("offset", "char", "word"), x, strict=True)) for x in homoglyphs(t)] for t in text.to_pylist()], kind)

    return run


def inspection(docs: DataFrame, policy: UnicodePolicy | None = None) -> DataFrame:
    """doc_id, number (from 0), offset, codepoint, char, kind, severity, removable, replacement, protected_by of every finding, carriers and confusables in one order.

    Both lists stand in the document's row and are merged there, without a shuffle.
    """
    policy = policy or UnicodePolicy()
    text = F.col("text")
    some = docs.filter(text.rlike(f"{ucd.notable_pattern()}|[{_GLYPHS}]"))
    kind = "struct<kind:string,severity:string,removable:boolean,replacement:string,protected_by:string>"
    row = lambda at, c, v: F.struct(at.alias("offset"), F.ascii(c).alias("codepoint"), c.alias("char"), v.cast(kind).alias("v"))
    judged = F.filter(F.transform(carriers(text), lambda c: row(c["offset"], c["char"], verdict(c, policy))), lambda f: f["v"].isNotNull())
    kept = F.struct(F.lit("confusable").alias("kind"), F.lit("suspicious").alias("severity"), F.lit(False).alias("removable"), F.lit(None).cast("string").alias("replacement"), F.lit("substitution_would_change_meaning").alias("protected_by"))
    like = F.transform(F.coalesce(F.col("_like"), F.array().cast("array<struct<offset:int,char:string,word:string>>")), lambda g: row(g["offset"], g["char"], kept))
    both = some.select("doc_id", "text", _homoglyphs()(F.when(text.rlike(f"[{_GLYPHS}]"), text)).alias("_like"))
    return both.select("doc_id", F.posexplode(F.array_sort(F.concat(judged, like))).alias("number", "f")).select("doc_id", "number", "f.offset", "f.codepoint", "f.char", "f.v.*")


def confusables(docs: DataFrame) -> DataFrame:
    """doc_id, word, char, latin: homoglyphs in words that hold a Latin letter; reported, never changed."""
    glyphs = "".join(ucd.CONFUSABLE)
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0)
    some = docs.filter(F.col("text").rlike(f"[{glyphs}]")).select("doc_id", F.posexplode(words).alias("word_no", "word"))
    mixed = some.filter((F.length("word") >= 2) & F.col("word").rlike("[A-Za-z]") & F.col("word").rlike(f"[{glyphs}]"))
    chars = mixed.select("doc_id", "word_no", "word", F.posexplode(F.split("word", "")).alias("place", "char")).filter(F.col("char").rlike(f"^[{glyphs}]$"))
    return chars.withColumn("latin", F.translate("char", glyphs, "".join(ucd.CONFUSABLE.values())))


def scripts(docs: DataFrame) -> DataFrame:
    """doc_id, scripts: the sorted scripts whose letters or marks a document holds."""
    # one pass leaves a text's distinct characters beyond ASCII; the scripts are looked for in these few
    rest = F.array_join(F.array_distinct(F.split(F.regexp_replace("text", "[\\x00-\\x7F]+", ""), "")), "")
    few = F.concat(F.when(F.col("text").rlike("[A-Za-z]"), F.lit("A")).otherwise(F.lit("")), rest)
    held = lambda c: F.array(*(F.when(c.rlike(f"[{ucd.script_class(s)}]"), F.lit(s)) for s in ucd.script_names()))
    return docs.select("doc_id", F.array_sort(F.array_compact(F.get(F.transform(F.array(few), held), F.lit(0)))).alias("scripts"))


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_lines, sha256."""
    t = F.coalesce("text", F.lit(""))
    lines = F.when(F.length(t) > 0, F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return docs.select("doc_id", F.length(t).alias("n_chars"), lines.alias("n_lines"), F.sha2(t, 256).alias("sha256"))
