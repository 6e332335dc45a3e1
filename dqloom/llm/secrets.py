"""Secret scan with linking of credential parts that occur near each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.llm.common import cut_lineage

# The kinds in listed order with their patterns.  Runs shorter than the least length of ``access``
# and ``hex`` never match, as a run is always taken whole; ``assign`` is judged by its group 2 afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts: only reported next to complementary parts.
WEAK_ID = r"\b(?:(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{12,}|(?i:client_?id|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,})"
# a whole run of any length; possessive, so each look-ahead reads it once
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = r"\b(?:https?|wss?|s3|ftp|jdbc:[a-z]{2,12})://[^\x00-\x20\"'<>|]+"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE, WEAK = KINDS[:3], KINDS[3:]
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT), strict=True))

# A part is in a candidate's scope if at most half of this many code points lie between them.
SCOPE = 512
SPAN = "struct<start:int,rank:int,end:int>"
# Elements that one step of a running value copies at most, and code points of the pieces that masking cuts from.
BLOCK, CHUNK = 256, 4096


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, merge) -> Column:
    """Running sum or maximum of an array of ints of at least 0, ``merge`` being the sum or maximum of two.

    Arrays are copied when they grow, so blocks are run through by themselves and then raised by what came before.
    """

    def run(block: Column) -> Column:
        return F.aggregate(
            block, F.expr("cast(array() as array<int>)"), lambda out, v: F.concat(out, F.array(merge(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)), v)))
        )

    def raised(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), run(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, low: F.transform(b, lambda v: merge(low, v))))

    def blocks(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(whole), F.lit(BLOCK))
        return F.when(F.size(whole) > 0, _let(F.transform(starts, lambda at: run(F.slice(whole, at, BLOCK))), raised)).otherwise(whole)

    return _let(values, blocks)


def _spans(kind: str, content: Column) -> Column:
    """The matches of one kind as (start, rank of the kind, end), in code points.

    The text between the matches gives the positions: every match starts where the gaps and matches before it end.
    """
    pattern = F.lit(PATTERNS[kind])

    def place(found: Column) -> Column:
        gaps = F.slice(F.split(content, PATTERNS[kind], -1), 1, F.size(found))
        ends = _running(F.zip_with(gaps, found, lambda gap, match: F.length(gap) + F.length(match)), lambda x, y: x + y)

        def span(end: Column, match: Column) -> Column:
            made = F.struct((end - F.length(match)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
            # group 2 may be too short; the match has used up its text nevertheless
            return F.when(F.length(F.regexp_extract(match, PATTERNS[kind], 2)) >= ASSIGN_LEAST, made) if kind == "assign" else made

        placed = F.zip_with(ends, found, span)
        placed = F.filter(placed, lambda s: s.isNotNull()) if kind == "assign" else placed
        return F.when(F.size(found) > 0, placed).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))

    return _let(F.regexp_extract_all(content, pattern, F.lit(0)), place)


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__base`` and ``__weak``: arrays of (start, rank, end), ordered by start, then by kind as listed."""
    content = F.coalesce(F.col(text), F.lit(""))
    gates = {"access": F.contains(content, F.lit("AKIA")), "endpoint": F.contains(content, F.lit("://"))}
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = docs.withColumns({f"__{k}": F.when(gates[k], _spans(k, content)).otherwise(none) if k in gates else _spans(k, content) for k in KINDS})
    return found.withColumns(
        {
            "__base": F.sort_array(F.concat(*(f"__{k}" for k in BASE))),
            "__weak": F.sort_array(F.concat(*(f"__{k}" for k in WEAK))),
        }
    ).drop(*(f"__{k}" for k in KINDS))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per ``__row`` the weak spans that complementary parts accompany: (``__row``, ``__linked``).

    The scope of a weak span is its interval, widened by half of ``scope`` on both sides; a part is in it if its own
    interval meets it, so a link depends on the code points between two parts and never on where the document starts.
    An interval join finds the parts of every scope: both sides are laid on cells as long as ``scope``, meet where
    they share a cell, and are compared there.  A weak identifier needs a secret (assign, hex, weak_secret), a weak
    secret an identifier (access, weak_id) or an endpoint, and an endpoint needs both others.

    Spans of a kind never overlap and have a least length, so a cell meets a bounded number of them however many a
    document holds, and no row counts more than its part of the text.
    """
    half = scope // 2
    rank = F.col("span.rank")
    parts = found.where(F.size("__weak") > 0).where(F.size("__base") + F.size("__weak") > 1)
    parts = parts.select("__row", F.explode(F.concat("__base", "__weak")).alias("span"))

    def cells(begin: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(begin / scope), F.floor(end / scope)))

    kinds = {
        "id": ("access", "weak_id"),
        "secret": ("assign", "hex", "weak_secret"),
        "endpoint": ("endpoint",),
    }
    company = parts.select("__row", F.col("span").alias("part"), cells(F.col("span.start"), F.col("span.end")).alias("cell"))
    scopes = parts.where(rank >= len(BASE)).select("__row", "span", cells(F.col("span.start") - half, F.col("span.end") + half).alias("cell"))
    # a part in its own scope is no company: no kind complements itself
    near = (F.col("part.start") <= F.col("span.end") + half) & (F.col("part.end") >= F.col("span.start") - half)
    has = [
        F.max(F.col("part.rank").isin(*(KINDS.index(k) for k in members))).alias(f"has_{name}") for name, members in kinds.items()
    ]
    met = scopes.join(company, ["__row", "cell"]).where(near).groupBy("__row", "span").agg(*has)
    enough = (
        F.when(rank == KINDS.index("weak_id"), F.col("has_secret"))
        .when(rank == KINDS.index("weak_secret"), F.col("has_id") | F.col("has_endpoint"))
        .when(rank == KINDS.index("endpoint"), F.col("has_id") & F.col("has_secret"))
    )
    return met.where(enough).groupBy("__row").agg(F.collect_list("span").alias("__linked"))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row of ``docs`` with ``__base`` (certain spans) and ``__spans`` (these and the linked weak ones).

    Spans are structs (start, rank of the kind in ``KINDS``, end), in code points, the end exclusive, ordered by
    start and kind.  A null text counts as empty and has none; repeated rows are scanned each by itself; overlapping
    kinds are all reported; an empty table gives an empty result.  Texts are scanned whole.  Only rows with weak
    parts and company are exploded, and only their spans are shuffled, never their text.
    """
    # the row number ties spans to rows; the written copy of the narrow columns keeps it stable
    rows = spans(docs, text).withColumn("__row", F.monotonically_increasing_id())
    narrow = cut_lineage(rows.drop(text))
    return narrow.join(linked(narrow, scope), "__row", "left").withColumn(
        "__spans", F.sort_array(F.concat("__base", F.coalesce("__linked", F.expr(f"cast(array() as array<{SPAN}>)"))))
    ).drop("__row", "__weak", "__linked")


def as_text(spans_column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.col(spans_column), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def count_of(spans_column: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans_column), lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def _masked(content: Column, cut: Column, label: str) -> Column:
    """``content`` with the spans ``cut``, ordered by start, replaced by ``label``; overlapping ones are one.

    The pieces between them are cut from chunks of the text, as positions in a string are counted from its start.
    """

    def pieces(chunks: Column, ends: Column) -> Column:
        def piece(p: Column) -> Column:
            first, last = F.floor(p["from"] / CHUNK).cast("int"), F.floor(p["to"] / CHUNK).cast("int")
            chunk = F.coalesce(F.get(chunks, first), F.lit(""))
            inside = F.substring(chunk, p["from"] % CHUNK + 1, p["to"] - p["from"])
            across = F.concat(
                F.substring(chunk, p["from"] % CHUNK + 1, F.lit(CHUNK)),
                F.array_join(F.slice(chunks, first + 2, last - first - 1), ""),
                F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), p["to"] % CHUNK),
            )
            return F.when(first == last, inside).otherwise(across)

        before = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends))
        heads = F.zip_with(before, cut, lambda at, span: F.struct(at.alias("from"), span["start"].alias("to")))
        tail = F.struct(F.get(ends, F.size(ends) - 1).alias("from"), F.length(content).alias("to"))
        kept = F.concat(F.filter(heads, lambda p: p["from"] <= p["to"]), F.array(tail))
        return F.array_join(F.transform(kept, piece), label)

    ends = _running(F.transform(cut, lambda span: span["end"]), F.greatest)
    chunks = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return _let(chunks, lambda c: _let(ends, lambda e: pieces(c, e)))


def mask(docs: DataFrame, text: str = "text", scope: int = SCOPE, label: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` but endpoints replaced by ``label``; overlapping spans are one.

    Rows without a span keep their text unchanged, null and empty included; no row goes.  Repeated rows are masked
    each by itself, an empty table gives an empty one, and whole texts are masked in time near linear in their length
    and spans.
    """
    found = spans(docs, text).withColumn("__row", F.monotonically_increasing_id())
    narrow = cut_lineage(found.where(F.size("__base") + F.size("__weak") > 0))
    touched = narrow.join(linked(narrow, scope), "__row", "left")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    cut = F.sort_array(F.filter(F.concat("__base", F.coalesce("__linked", none)), lambda s: s["rank"] != KINDS.index("endpoint")))
    masked = _let(cut, lambda c: F.when(F.size(c) > 0, _masked(F.col(text), c, label)).otherwise(F.col(text)))
    clean = found.where(F.size("__base") + F.size("__weak") == 0).select(docs.columns)
    return clean.unionByName(touched.withColumn(text, masked).select(docs.columns))
