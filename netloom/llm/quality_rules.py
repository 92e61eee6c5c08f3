"""Quality rules: base counts of a text, and how far its distributions diverge from its language.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import BLANKS, stored, words

#: Common words of each language with a reference; the histogram has a bin for each and one for the rest.
COMMON_WORDS = {
    "de": ("der", "die", "und", "das", "ein", "ist", "von", "mit", "nicht", "den"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with"),
    "es": ("el", "la", "de", "que", "los", "en", "un", "por", "con", "las"),
    "fr": ("le", "la", "de", "et", "les", "des", "un", "une", "que", "dans"),
}
#: Of any other language in the corpus, so many of its most frequent words are its common words.
OWN_WORDS = 10
#: Character classes taken off a text one after the other; what is left is a class too.
CLASSES = (("lower", r"\p{Ll}+"), ("blank", f"[{BLANKS}]+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{N}+"), ("symbol", r"[#*$%&|<>]+"), ("stop", r"[.,;:!?]+"))
MIN_WORDS = 50
#: Largest Jensen-Shannon distances, and the lengths from which they count.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.3, 200
MAX_WORD_DISTANCE, MIN_WORDS_FOR_COMMON = 0.27, 100


def repeated_positions() -> Column:
    """Ascending positions of the windows that a text holds twice or more.

    ``__h`` has each window's 64-bit hash by position. ``__packed`` has, in ascending order, the
    hash's high bits with the position in the low bits that ``__low`` masks, so equal windows are
    neighbours there; the full hashes of neighbours are compared.
    """
    low, packed = F.col("__low"), F.col("__packed")

    def full(x: Column) -> Column:
        return F.get("__h", x.bitwiseAND(low).cast("int"))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a.bitwiseXOR(b) <= low) & (a.bitwiseXOR(b) >= 0) & (full(a) == full(b)), F.lit(False))

    twice = F.filter(packed, lambda x, i: same(x, F.get(packed, i - 1)) | same(x, F.get(packed, i + 1)))
    return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low)))


def other_language(lang: str) -> Column:
    """Whether a row has a language that COMMON_WORDS does not list."""
    return F.coalesce(~F.col(lang).isin(*COMMON_WORDS), F.lit(False))


def own_words(docs: DataFrame) -> DataFrame | None:
    """(__of, __own): the most frequent words of each language that COMMON_WORDS does not list; None without such rows."""
    others = docs.filter(other_language("lang")).select("lang", "text")
    if others.isEmpty():
        return None
    seen = others.select("lang", F.explode(words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    top = seen.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter(F.col("i") <= OWN_WORDS)
    return stored(top.groupBy(F.col("lang").alias("__of")).agg(F.sort_array(F.collect_list("w")).alias("__own")), "own-words")


def text_features(docs: DataFrame, carry: list[str], own: DataFrame | None = None) -> DataFrame:
    """Base counts and histograms of every text beside the ``carry`` columns, written to the shared folder.

    ``__chars`` counts code points by class, ``__common`` the words of COMMON_WORDS and the rest.
    With ``own``, ``__mine`` counts the rest and the words of the row's language in ``own``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    held = [F.col(c).alias(f"c__{c}") for c in carry]
    names = [f"c__{c}" for c in carry]
    df = docs.select(*held, F.col("lang").alias("__lang"), text.alias("__text"), words(F.col("text")).alias("__words"))
    if own is not None:
        counts = F.transform("__own", lambda v: F.size(F.filter("__words", lambda w: w == v)).cast("long"))
        rest = F.size(F.filter("__words", lambda w: ~F.array_contains("__own", w))).cast("long")
        df = df.join(F.broadcast(own), F.col("__lang") == F.col("__of"), "left").withColumn("__mine", F.concat(F.array(rest), counts)).drop("__of", "__own")
        names = [*names, "__mine"]

    df = df.withColumn("__r0", F.col("__text"))
    for i, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"__r{i + 1}", F.regexp_replace(f"__r{i}", pattern, "")).withColumn(f"__n{i}", F.length(f"__r{i}") - F.length(f"__r{i + 1}"))
    left = F.length(f"__r{len(CLASSES)}")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = df.select(
        *names, "__lang", "__words",
        F.size("__words").alias("__n"),
        F.array(*[F.col(f"__n{i}").cast("long") for i in range(len(CLASSES))], left.cast("long")).alias("__chars"),
        lines.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__w"),
        F.filter("__words", lambda w: w.isin(*vocabulary())).alias("__known"),
    )
    turned = F.zip_with("__w", F.slice(F.col("__w"), 2, F.greatest(F.col("__n"), F.lit(1))), lambda a, b: a.bitwiseXOR(rotated(b, 21)))
    third = F.slice(F.col("__w"), 3, F.greatest(F.col("__n"), F.lit(1)))
    hashed = F.slice(F.zip_with(turned, third, lambda a, c: a.bitwiseXOR(rotated(c, 42))), 1, F.greatest(F.col("__n") - 2, F.lit(0)))
    df = df.select(
        *names, "__lang", "__n", "__chars",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[(F.size("__known") - F.size(F.array_remove("__known", w))).cast("long") for w in vocabulary()], (F.size("__words") - F.size("__known")).cast("long")).alias("__common"),
        hashed.alias("__h"),
        (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.col("__n")))) - 1).alias("__low"),
    )
    df = df.select("*", F.sort_array(F.transform("__h", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("__low"))).bitwiseOR(i.cast("long").bitwiseAND(F.col("__low"))))).alias("__packed"))
    df = df.select(*names, "__lang", "__n", "__chars", "n_dup_lines", "__common", repeated_positions().alias("__at"))
    gaps = F.zip_with(F.slice(F.col("__at"), 2, F.greatest(F.size("__at"), F.lit(1))), "__at", lambda b, a: F.least(b - a, F.lit(3).cast("long")))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(3).cast("long")))
    symbol = [name for name, _ in CLASSES].index("symbol")
    blank = [name for name, _ in CLASSES].index("blank")
    total = F.aggregate("__chars", F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.select(
        *names, "__lang", "__chars", "__common",
        F.col("__n").cast("long").alias("n_words"),
        (total - F.get("__chars", F.lit(blank))).alias("word_chars"),
        F.get("__chars", F.lit(symbol)).alias("n_symbols"),
        "n_dup_lines",
        covered.alias("n_repeat_words"),
    )
    return stored(df, "text-features")


def rotated(x: Column, by: int) -> Column:
    """The 64 bits of ``x`` turned left."""
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def vocabulary() -> list[str]:
    """All common words, each once."""
    return sorted({w for ws in COMMON_WORDS.values() for w in ws})


def language_references(features: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Summed histograms of all documents of each language of COMMON_WORDS: one row a language."""
    bins = (len(CLASSES) + 1, len(vocabulary()) + 1)
    sums = [F.sum(F.get(c, F.lit(i))) for c, k in zip(("__chars", "__common"), bins, strict=True) for i in range(k)]
    rows = features.filter(F.col("__lang").isin(*COMMON_WORDS)).groupBy("__lang").agg(*sums).collect()
    return {r[0]: (list(r[1 : 1 + bins[0]]), list(r[1 + bins[0] :])) for r in rows}


def own_references(features: DataFrame) -> DataFrame:
    """(__of, __ref_chars, __ref_mine): shares over all documents of each language that COMMON_WORDS does not list."""
    bins = {"__chars": len(CLASSES) + 1, "__mine": OWN_WORDS + 1}
    sums = [F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) for i in range(k)]).alias(f"s{c}") for c, k in bins.items()]
    summed = features.filter(other_language("__lang")).groupBy(F.col("__lang").alias("__of")).agg(*sums)

    def shares(c: str) -> Column:
        whole = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.transform(c, lambda x: x / F.greatest(whole, F.lit(1)))

    return stored(summed.select("__of", shares("s__chars").alias("__ref_chars"), shares("s__mine").alias("__ref_mine")), "own-references")


def js_distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram column to reference counts."""
    whole = float(sum(reference)) or 1.0
    return js_shares(counts, F.array(*[F.lit(x / whole) for x in reference]))


def js_shares(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram column to the shares of a reference."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    # x / (x / total + q) keeps the share and its mean with the reference in one expression.

    def part(x: Column, q: Column) -> Column:
        p = x / total
        mean = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mean)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / mean)).otherwise(F.lit(0.0))

    summed = F.aggregate(F.zip_with(counts, shares, part), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(summed / 2, F.lit(0.0)))


def apply_quality_rules(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``docs`` (text, lang and the ``carry`` columns) with base counts, distances and verdicts.

    A text fails the base rules with under 50 words or over half its words in repeated 3-word
    windows. One that passes is kept if its character classes and its common words lie near the
    reference of its language, each distance counting from a minimum length on. Languages that
    COMMON_WORDS lists are compared by those words, any other by its own most frequent ones. Without
    a language (null) the nearest listed reference counts; if there are none, or the corpus has
    other languages that the text may be in, no distance does.
    Null and empty texts have no words and fail. Equal rows are judged alike.
    """
    own = own_words(docs)
    features = text_features(docs, carry, own)
    known = language_references(features)
    if own is not None:
        features = features.join(F.broadcast(own_references(features)), F.col("__lang") == F.col("__of"), "left")
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)

    def distance(column: str, which: int) -> Column:
        each = {k: js_distance(F.col(column), r[which]) for k, r in sorted(known.items())}
        cases = [(F.col("__lang") == k, d) for k, d in each.items()]
        if own is not None:
            mine, ref = (("__chars", "__ref_chars"), ("__mine", "__ref_mine"))[which]
            cases.append((F.col(ref).isNotNull(), js_shares(F.col(mine), F.col(ref))))
        out = F.array_min(F.array(*each.values())) if each and own is None else F.lit(0.0)
        for hit, d in reversed(cases):
            out = F.when(hit, d).otherwise(out)
        return out

    chars = F.when(F.col("word_chars") >= MIN_CHARS, distance("__chars", 0))
    common = F.when(n >= MIN_WORDS_FOR_COMMON, distance("__common", 1))
    df = features.withColumns({"base_failed": base, "char_distance": F.when(~base, chars), "word_distance": F.when(~base, common)})
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return df.select(
        *[F.col(f"c__{c}").alias(c) for c in carry],
        *[F.col(c).alias(c if c not in carry else f"{c}_found") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance")],
        (~base & ~far).alias("kept" if "kept" not in carry else "kept_found"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject; all columns stay."""
    judged = apply_quality_rules(docs, docs.columns)
    return judged.filter("kept_found" if "kept" in docs.columns else "kept").select(*docs.columns)
