"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Base patterns give spans of assignments, access keys and long hexadecimal runs.  More
candidates (key-shaped tokens of other forms) are judged by who else has them: every
candidate's hash is counted over distinct owners and distinct repositories.  A value
that many owners share is a copied example or a public constant; one that stays with
few owners is taken for live and its span is added.

Positions come from the gaps between matches: ``split`` gives the text around the
matches and ``regexp_extract_all`` the matches themselves, so both lengths add up to
code-point offsets without any Python.

Defined results: a null text is empty (no spans); a null owner or repository counts
as one more owner or repository of its own kind; rows that repeat are scanned each;
a null id is kept; empty tables give empty tables; for ``redact`` all other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import scratch_name, written
from .quality_rules import let

#: Base kinds in the order of ties.  The assignment keeps matches whose value is long
#: enough; runs of the other kinds can be held to their least length in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE = {"assign": (ASSIGN, 12), "access": (ACCESS, 0), "hex": (HEX, 0)}

# Shapes of further credentials (public prefixes of token formats, JSON
# web tokens, key blocks, credentials in addresses, and long mixed-case keys), with
# what a match must contain.
CANDIDATES = {
    "vendor": (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}", ()),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", ()),
    "keyblock": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", ()),
    "address": (r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!$-]{6,128}@", ()),
    "mixed": (r"[A-Za-z0-9+/_-]{32,}", ("[A-Z]", "[a-z]", "[0-9]")),
}
KINDS = [*BASE, *CANDIDATES]
# A key block is matched whole: to its end line, or as far as lines of key characters go.
_KEY_END = r"-----END [A-Z ]{0,20}PRIVATE KEY-----"
_KEY_BODY = r"""(?:(?:\\[nr]|[\s"'+,]){1,12}[A-Za-z0-9+/]{16,}={0,2}){1,400}(?:(?:\\[nr]|[\s"'+,]){1,12}[A-Za-z0-9+/]{1,15}={1,2})?"""
KEYBLOCK = rf"""{CANDIDATES["keyblock"][0]}(?:[A-Za-z0-9+/=\s\\:,."'-]*?{_KEY_END}|{_KEY_BODY})?"""
_NO_KEY = rf"-----(?:BEGIN|END) [A-Z ]{{0,20}}PRIVATE KEY-----|\\[nr]|[^A-Za-z0-9+/=]"
#: What the scan matches; ``CANDIDATES`` states the header alone, as the SQL does.
MATCHED = {**CANDIDATES, "keyblock": (KEYBLOCK, ())}
#: Texts without any of these can hold no candidate.
_HINT = r"gh[pousr]_|xox[abprs]-|sk_(?:live|test)_|AIza|glpat-|eyJ|PRIVATE KEY|://|[A-Za-z0-9+/_-]{32}"

_NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _having(pattern: str):
    return lambda s: s["value"].rlike(pattern)


_CHUNK = 64


def _chunks(a: Column) -> Column:
    last = F.floor((F.size(a) - 1) / _CHUNK).cast("int")
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(a, c * _CHUNK + 1, _CHUNK))).otherwise(F.array())


def running(a: Column, op, levels: int = 1) -> Column:
    """What ``op`` (the sum, or the greatest) makes of the elements before each one, from
    zero.  Chunk by chunk, then over the chunks' totals, so that the work is nearly in
    proportion to the array."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), op)
    short = F.transform(a, lambda x, j: total(F.slice(a, 1, j)))
    if not levels:
        return short

    def long(chunks):
        before = let(F.transform(chunks, total), lambda t: running(t, op, levels - 1))
        return F.flatten(F.zip_with(chunks, before, lambda c, s: F.transform(c, lambda x, j: op(s, total(F.slice(c, 1, j))))))

    return F.when(F.size(a) <= _CHUNK, short).otherwise(let(_chunks(a), long))


def spans_of(text: Column, pattern: str, kind: int, least: int = 0, must: tuple[str, ...] = ()) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, kind, end, value), code
    points, end exclusive; ``least``: matches whose first group is shorter are dropped,
    as are those without one of ``must``."""
    def placed(parts):
        def span(x, at):
            start = at + x["g"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

        steps = F.transform(parts, lambda x: (x["g"] + F.length(x["m"])).cast("bigint"))
        return F.zip_with(parts, let(steps, lambda a: running(a, lambda s, x: s + x)), span)

    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("bigint").alias("g")))
    found = let(F.filter(parts, lambda x: x["m"].isNotNull()), placed)
    for one in must:
        found = F.filter(found, _having(one))
    if least:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], pattern, 1)) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_NO_SPANS))


def base_spans(text: Column) -> Column:
    return F.sort_array(F.concat(*(spans_of(text, p, k, least) for k, (p, least) in enumerate(BASE.values()))))


def candidate_spans(text: Column) -> Column:
    found = F.concat(*(spans_of(text, p, len(BASE) + k, 0, must) for k, (p, must) in enumerate(MATCHED.values())))
    return F.when(text.rlike(_HINT), found).otherwise(F.array().cast(_NO_SPANS))


def _credential(s: Column) -> Column:
    """What is compared over the corpus: of an assignment the value alone, of a key block
    its body (a header without one stands for itself)."""
    return F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 1)).when(s["kind"] == KINDS.index("keyblock"), _key(s["value"])).otherwise(s["value"])


def _key(block: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(block, _NO_KEY, ""), F.lit("")), block)


def joined(spans: Column) -> Column:
    """``kind:start:end`` in order, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _meet(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _apart(spans: Column, base: Column) -> Column:
    """The ``spans`` that overlap none of ``base`` (sorted), which is looked up by chunks."""
    def grouped(items):
        return F.transform(_chunks(items), lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end"), c.alias("items")))

    def rest(index):
        near = lambda s: F.exists(index, lambda a: _meet(a, s) & F.exists(a["items"], lambda b: _meet(b, s) & F.exists(b["items"], lambda c: _meet(c, s))))
        return F.filter(spans, lambda s: ~near(s))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(let(let(grouped(base), grouped), rest))


def credentials(text: Column) -> Column:
    """Base spans and the candidates that overlap none of them, in order: array of
    struct(start, kind, end, hash); the hash stands for what is compared over the corpus."""
    def both(x):
        return F.sort_array(F.concat(x["base"], _apart(x["more"], x["base"])))

    every = let(F.struct(base_spans(text).alias("base"), candidate_spans(text).alias("more")), both)
    return F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(_credential(s), 256).alias("hash")))


def ownership(seen: DataFrame, max_owners: int, max_repositories: int | None) -> DataFrame:
    """``seen(hash, owner, repository)`` -> ``(h, live)`` per distinct value: live with at
    most so many distinct owners and repositories (None: owners alone count).  One row per (value, owner,
    repository), then per (value, owner): a value that is everywhere is reduced before
    it meets in one place."""
    owned = seen.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("x")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    found = owned.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    few = F.lit(True) if max_repositories is None else F.col("repositories") <= max_repositories
    return written(found.select(F.col("hash").alias("h"), ((F.col("owners") <= max_owners) & few).alias("live")), "ownership")


def _is_base(s: Column) -> Column:
    return s["kind"] < len(BASE)


def _repository(df: DataFrame, column: str | None, limit: int) -> tuple[Column, int | None]:
    return (df[column].cast("string"), limit) if column else (F.lit(None).cast("string"), None)



def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None,
         max_owners: int = 2, max_repositories: int = 50) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_live, n_example`` and ``all_spans`` (array of struct(start, kind, end)).

    ``owner_col`` names who owns a row and ``repository_col`` its repository.  A
    candidate is live with at most ``max_owners`` distinct owners and, where
    repositories are named, at most ``max_repositories`` distinct ones: the documents of
    one owner are no repositories.  ``n_live`` and ``n_example`` count all
    candidates, base ones included; live ones of the further kinds add spans, unless they
    overlap a base span."""
    text = F.coalesce(df[text_col], F.lit(""))
    repository, limit = _repository(df, repository_col, max_repositories)
    found = df.select(df[id_col].alias("doc_id"), df[owner_col].cast("string").alias("owner"), repository.alias("repository"), credentials(text).alias("more"))
    rows = written(found.withColumn("row", F.monotonically_increasing_id()), "scanned")
    rows = rows.withColumn("base", F.transform(F.filter("more", _is_base), lambda s: s.dropFields("hash")))
    seen = rows.where(F.size("more") > 0).select("row", "owner", "repository", F.explode("more").alias("s")).select("row", "owner", "repository", "s.*")
    live = ownership(seen, max_owners, limit)
    judged = seen.join(live, F.col("hash") == F.col("h"))
    added = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("live") & (F.col("kind") >= len(BASE)), F.struct("start", "kind", "end"))).alias("live_spans"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example")
    )
    out = rows.join(added.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.sort_array(F.concat("base", F.coalesce("live_spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), every.alias("all_spans"),
    )


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with what the ``spans`` (sorted) cover replaced, overlapping ones by one
    ``mask``.  Pieces are cut from a form of four bytes a character, so that each cut
    costs its own length."""
    lead = F.encode(F.lit("x"), "UTF-32")  # keeps a byte-order mark inside a text as it is
    ends = let(F.transform(spans, lambda s: s["end"]), lambda e: running(e, lambda s, x: F.greatest(s, x)))

    def cut(b):
        piece = lambda a, n: F.substring(F.decode(F.concat(lead, F.substring(b, (4 * a + 1).cast("int"), (4 * n).cast("int"))), "UTF-32"), F.lit(2), F.lit(2**31 - 1))
        parts = F.zip_with(spans, ends, lambda s, e: F.when(s["start"] >= e, F.concat(piece(e, s["start"] - e), F.lit(mask))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(last, F.lit(2**28).cast("bigint")))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), cut)).otherwise(text)


def redact(df: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str | None = None,
           max_owners: int = 2, max_repositories: int = 50, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every base span and every live candidate, as ``scan`` judges them, replaced
    by ``mask``; all rows and columns stay, a null text stays null.  Only rows with
    candidates are shuffled."""
    key, live_col, more_col = (scratch_name(df, x) for x in ("text_hash", "live", "more"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = written(df.withColumn(more_col, credentials(text)), "marked")
    repository, limit = _repository(marked, repository_col, max_repositories)
    seen = marked.where(F.size(more_col) > 0).select(marked[owner_col].cast("string").alias("owner"), repository.alias("repository"), F.explode(more_col).alias("s"))
    live = ownership(seen.select("owner", "repository", "s.hash"), max_owners, limit)
    more = F.exists(more_col, lambda s: ~_is_base(s))
    some = marked.where(more)
    asked = some.select(F.sha2(text, 256).alias("key"), F.explode(F.filter(more_col, lambda s: ~_is_base(s))).alias("s")).select("key", "s.*").distinct()
    by_text = asked.join(live.where("live"), F.col("hash") == F.col("h"))
    by_text = written(by_text.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "kind", "end")).alias(live_col)), "live-by-text")

    def clean(rows, spans):
        return rows.withColumn(text_col, F.when(F.col(text_col).isNotNull(), let(spans, lambda x: masked(F.col(text_col), x, mask)))).select(*df.columns)

    base = F.transform(F.filter(more_col, _is_base), lambda s: s.dropFields("hash"))
    met = some.join(by_text, F.sha2(text, 256) == F.col(key), "left")
    return clean(marked.where(~more), base).unionByName(clean(met, F.sort_array(F.concat(base, F.coalesce(live_col, F.filter(base, lambda s: F.lit(False)))))))
