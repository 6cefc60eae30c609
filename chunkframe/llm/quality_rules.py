"""Quality rules with a distribution-divergence verdict, in DataFrame operations only.

Each text gets counts (words, symbols, repeated lines and windows), a histogram of
character classes and one of the common words of its language.  References are fixed
(``REFERENCE``; others can be passed per language, for example those of ``references`` over
texts that are known to be good), so the verdict of a text depends on that text alone.  A
text is rejected if the Jensen-Shannon distance of either histogram to its reference
passes a limit, which widens with fewer words, as short texts scatter: ``base + spread /
sqrt(words)``.  Below a least number of words there is no such verdict.

The limits were set by looking at the distances of the fixture's labelled texts.

Defined results: a null text is the empty text (no words, base fails); an unknown or
null language has no list of common words and is judged by character classes alone; empty tables give empty
tables; repeated rows are judged row by row; columns of ``df`` pass through, but one
with the name of the output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import scratch_name, without

# Common function words per language, at most 26 each.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "was", "on", "are", "as", "with", "be", "at", "this", "by", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "au", "par", "sur", "pas", "plus"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo"],
}
#: The language key of everything that has no list of its own.
OTHER = "other"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%\&|<>]"
#: Regular expressions of the classes; spaces and all other characters are two more.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "symbol": SYMBOLS, "mark": r"[.,;:!?'\"()\-]"}
WINDOW = 8
# Characters of ordinary prose per 1,000, in the order of ``CLASSES``, spaces, all
# others; and the share of the most common word (the next ones follow Zipf's law).
PROSE = [20.0, 3.0, 0.3, 25.0, 165.0, 786.7]
FIRST_WORD = 55.0


def zipf(words: int = 20) -> list[float]:
    """Occurrences of the most common words and of all others, per 1,000 words."""
    known = [FIRST_WORD / rank for rank in range(1, words + 1)]
    return [*known, 1000.0 - sum(known)]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_of(text: Column, one: str) -> Column:
    """How many characters of ``text`` are of the class ``one``."""
    inverse = rf"[^{one[1:-1]}]+" if one.startswith("[") else rf"\P{one[2:]}+"
    return F.length(F.regexp_replace(text, inverse, "")).cast("long")


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _covered(hashes: Column) -> Column:
    """Words in the windows whose hash occurs twice or more."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s):
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n"))
    return F.aggregate(let(marked, starts), first, step, lambda acc: acc["n"])


def repeated_words(words: Column) -> Column:
    """Words in windows of eight words that occur at least twice, the first included."""
    n = F.size(words)
    ends = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(ends, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(some)


#: Language -> (character classes, common words); ``OTHER`` holds for those not named.
REFERENCE = {OTHER: (PROSE, zipf())}


def language_key(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def _letters_of(words: Column, key: Column) -> Column:
    """One letter for each common word of the language, in a string."""
    def coded(language):
        pairs = [F.lit(v) for w, a in zip(COMMON_WORDS[language], _LETTERS) for v in (w, a)]
        return F.array_join(F.transform(words, lambda x: F.coalesce(F.try_element_at(F.create_map(*pairs), x), F.lit(""))), "")

    out = F.lit("")
    for language in COMMON_WORDS:
        out = F.when(key == language, coded(language)).otherwise(out)
    return out


def histograms(text: Column, lang: Column, words: Column) -> Column:
    """struct(classes array<long>, common array<long>): counts; the last bin is the rest."""
    known = [n_of(text, one) for one in CLASSES.values()]
    spaces = F.length(text) - F.length(F.regexp_replace(text, SPACE + "+", ""))
    classes = let(F.array(*known, spaces.cast("long")), lambda c: F.concat(c, F.array(F.length(text) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))

    def bins(s):
        return F.array(*((F.length(s) - F.length(F.replace(s, F.lit(a), F.lit("")))).cast("long") for a in _LETTERS[:20]), (F.size(words) - F.length(s)).cast("long"))

    common = let(_letters_of(words, language_key(lang)), bins)
    return F.struct(classes.alias("classes"), common.alias("common"))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; 0 if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def divergence(t):
        each = F.zip_with(counts, reference, lambda c, r: let(F.struct((c / t["c"]).alias("p"), (r / t["r"]).alias("q")),
                          lambda b: (term(b["p"], (b["p"] + b["q"]) / 2) + term(b["q"], (b["p"] + b["q"]) / 2)) / 2))
        return F.when((t["c"] > 0) & (t["r"] > 0), F.sqrt(F.greatest(total(each), F.lit(0.0)))).otherwise(0.0)

    return let(F.struct(total(counts).alias("c"), total(reference).alias("r")), divergence)


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """Language -> (class counts, common-word counts) summed over ``df``, with ``OTHER`` for the
    sum of all: a handful of rows, whatever the corpus."""
    text = F.coalesce(df[text_col], F.lit(""))
    slim = df.select(language_key(df[lang_col]).alias("key"), let(word_array(text), lambda w: histograms(text, df[lang_col], w)).alias("h"))
    n_classes, n_common = len(CLASSES) + 2, 21
    sums = [F.sum(F.col("h.classes")[j]).alias(f"a{j}") for j in range(n_classes)] + [F.sum(F.col("h.common")[j]).alias(f"b{j}") for j in range(n_common)]
    found = {r["key"]: ([r[f"a{j}"] for j in range(n_classes)], [r[f"b{j}"] for j in range(n_common)]) for r in slim.groupBy("key").agg(*sums).collect()}
    found[OTHER] = tuple([sum(v[i][j] for v in found.values()) for j in range(n)] for i, n in ((0, n_classes), (1, n_common)))
    return found


def judge(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = 20, max_repeat_percent: int = 30,
          class_limit: tuple[float, float] = (0.1, 1.0), common_limit: tuple[float, float] = (0.1, 1.7), least_words: int = 20,
          output: str = "quality", reference: dict | None = None) -> DataFrame:
    """Add the struct column ``output``: ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, class_distance, common_distance, base_failed, kept``."""
    df = without(df, output, keep=(text_col, lang_col))
    known = reference or REFERENCE
    text = F.coalesce(df[text_col], F.lit(""))

    def of_language(part):
        out = F.array(*(F.lit(x) for x in known[OTHER][part]))
        for key, value in known.items():
            if key != OTHER:
                out = F.when(df[lang_col] == key, F.array(*(F.lit(x) for x in value[part]))).otherwise(out)
        return out

    def row(w):
        def counted(h):
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                (F.length(text) - h["classes"][len(CLASSES)]).cast("long").alias("word_chars"),
                h["classes"][list(CLASSES).index("symbol")].alias("n_symbols"),
                repeated_lines(text).alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                js_distance(h["classes"], of_language(0)).alias("class_distance"),
                F.when(language_key(df[lang_col]) == OTHER, 0.0).otherwise(js_distance(h["common"], of_language(1))).alias("common_distance"),
            )

        return let(histograms(text, df[lang_col], w), counted)

    def verdict(c):
        failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
        limit = lambda base, spread: base + spread / F.sqrt(c["n_words"])
        far = (c["n_words"] >= least_words) & ((c["class_distance"] > limit(*class_limit)) | (c["common_distance"] > limit(*common_limit)))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance")
        return F.struct(*(c[x].alias(x) for x in names), failed.alias("base_failed"), (~failed & ~far).alias("kept"))

    return df.withColumn(output, let(let(word_array(text), row), verdict))


def filtered(df: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``df`` that the rules keep, columns unchanged."""
    mark = scratch_name(df, "quality")
    return judge(df, text_col, lang_col, output=mark, **options).where(F.col(mark)["kept"]).drop(mark)
