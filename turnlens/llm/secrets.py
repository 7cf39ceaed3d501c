"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans are found in each text by itself. Weak candidates (an identifier, a
40-character secret, an endpoint, a value named as a secret key) are reported only where the parts that would
complete a credential stand in one scope: within SCOPE characters, with no blank
line, section head or rule between them. The interval join that decides this is an
equi-join on (text, section, stretch of SCOPE characters): the parts of a stretch
are first reduced to the smallest and largest start of each role, so no pair of
parts is ever formed. Offsets are running sums over pieces of an array, and over
the pieces' own sums, so a text with very many spans takes little more than time in
proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm import kernel
from turnlens.llm.durable import small

#: The patterns of strong kinds are fixed values; the number is the group whose length counts, and how long it must be.
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
WEAK = {
    "ident": r"""(?i:(?<![a-z0-9])(?<!secret[_-])(?:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "bare_secret": r"""(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""",
    "endpoint": r"""(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""",
    "named_secret": r"""(?i:secret(?:(?!secret)[a-z0-9_-])*?key|(?<![a-z0-9])pwd)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
}
KINDS = [*STRONG, *WEAK]
#: What each kind is as a part of a credential.
ROLE = {"assign": "secret", "hex": "secret", "bare_secret": "secret", "access": "identifier", "ident": "identifier", "endpoint": "endpoint", "named_secret": "secret"}
#: The roles that must be near a weak candidate.
NEEDS = {"ident": ["secret"], "bare_secret": ["identifier"], "endpoint": ["identifier", "secret"], "named_secret": ["identifier"]}
#: Two parts belong to one scope if their starts are at most this many characters apart, and nothing that ends a scope is between them.
SCOPE = 400
#: What ends a scope: a blank line, or a line that is a section head in brackets or a rule.
BREAK = r"\n(?=[\x20\t\r]*\n|\[[^\]\n]*\][\x20\t\r]*(?:\n|$)|-{3,}[\x20\t\r]*(?:\n|$))"
#: Texts are cut for redaction in pieces of this many characters.
PIECE = 1024
#: Texts with linked candidates are broadcast up to this many, else joined by a shuffle.
FEW = 20_000

_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
_LINK = "array<struct<start:bigint,rank:int,end:bigint,parts:array<struct<role:string,at:bigint>>>>"


def _long_enough(kind: str) -> str:
    """A pattern that finds something wherever a strong kind has a span that passes."""
    if kind == "hex":
        return r"[0-9a-f]{24}"
    return STRONG[kind][0] if kind == "assign" else r"AKIA[A-Z0-9]{16}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, start: int, out: str, step: Callable[[Column, Column], Column], gather: Callable[[Column, Column], Column], shift: Callable[[Column, Column], Column]) -> Column:
    """(at, out): a running value over an array, and what ``step`` appends to ``out`` for each item.

    Arrays can only grow by copying, so the array is cut into pieces of about the
    cube root of its size, each is run through by itself, and ``gather`` and
    ``shift`` carry the value of the pieces before over to a piece.
    """
    zero = lambda kind: F.struct(F.lit(start).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def pieces(x: Column) -> Column:
        most = F.ceil(F.cbrt(F.greatest(F.size(x), F.lit(1)))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), most), lambda i: F.slice(x, i + 1, most))

    def lay(acc: Column, piece: Column) -> Column:
        moved = F.transform(piece["out"], lambda o: shift(o, acc["at"]))
        return F.struct(gather(acc["at"], piece["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    laid = F.aggregate(F.transform(_let(items, pieces), lambda p: F.aggregate(p, zero(out), step)), zero(f"array<{out}>"), lay)
    return _let(laid, lambda r: F.struct(r["at"].alias("at"), F.flatten(r["out"]).alias("out")))


def _spans(text: Column, kind: str) -> Column:
    """Spans of a kind in code points: what lies between the matches, and the matches, give every offset in one pass."""
    if kind in STRONG:
        pattern, group, least = STRONG[kind]
        if kind == "hex":
            # shorter runs always fail, and a run can't hide in a failing one
            pattern = r"[0-9a-f]{24,}"
    else:
        pattern, group, least = WEAK.get(kind, BREAK), 0, 0
    rank = F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), value.alias("v"))
    span = lambda start, end: F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(
            F.struct(
                end.alias("at"),
                F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span(start, end)))).otherwise(acc["out"]).alias("out"),
            )
        )

    all_of = _running(steps, 0, _SPAN, step, lambda at, more: at + more, lambda o, at: span(o["start"] + at, o["end"] + at))
    some = text.rlike(_long_enough(kind) if kind in STRONG else pattern)
    return F.when(some, all_of["out"]).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def _told(links: Column) -> Column:
    """Each link as its span, < and the parts it goes with."""
    part = lambda x: F.concat_ws("@", x["role"], x["at"].cast("string"))
    return F.array_join(F.transform(links, lambda s: F.concat(_joined(F.array(s)), F.lit("<"), F.array_join(F.transform(s["parts"], part), "+"))), ",")


def _linked(docs: DataFrame, text_col: str, key: list[str]) -> DataFrame:
    """One row for each text that has weak candidates in complete company: the key and their spans."""
    text = F.col(text_col)
    any_of = lambda *patterns: text.rlike("|".join(f"(?:{p})" for p in patterns))
    both = docs.where(any_of(_long_enough("access"), WEAK["ident"])).where(
        any_of(*(_long_enough(k) for k in ("assign", "hex")), WEAK["bare_secret"], WEAK["named_secret"])
    )
    found = both.select(*key, F.explode(F.concat(*[_spans(text, k) for k in KINDS], _spans(text, "break"))).alias("span")).distinct()
    rank, so_far = F.col("span.rank"), Window.partitionBy(*key).orderBy("span.start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rank.isin(KINDS.index("assign"), KINDS.index("named_secret"))
    parts = (
        found.withColumn("section", F.count_if(rank == len(KINDS)).over(so_far))
        .withColumn("covered", F.max(F.when(whole, F.col("span.end"))).over(so_far))
        .where(rank < len(KINDS))
        # a bare secret inside an assignment is part of that
        .where((rank != KINDS.index("bare_secret")) | F.coalesce(F.col("covered") < F.col("span.end"), F.lit(True)))
        .select(
            *key,
            "span",
            F.struct("section", F.floor(F.col("span.start") / SCOPE).alias("at")).alias("cell"),
            F.get(F.array(*[F.lit(ROLE[k]) for k in KINDS]), rank).alias("role"),
        )
    )
    cells = parts.groupBy(*key, "cell", "role").agg(F.min("span.start").alias("low"), F.max("span.start").alias("high"))
    near_by = F.transform(F.sequence(F.col("cell.at") - 1, F.col("cell.at") + 1), lambda at: F.struct(F.col("cell.section").alias("section"), at.alias("at")))
    reach = cells.select(*key, F.explode(near_by).alias("cell"), "role", "low", "high")
    weak = parts.where(F.col("span.rank") >= len(STRONG)).drop("role")
    # at most three stretches of each of three roles meet a candidate; parts of its own stretch are always near
    at = F.when(F.abs(F.col("low") - F.col("span.start")) <= SCOPE, F.col("low")).when(F.abs(F.col("high") - F.col("span.start")) <= SCOPE, F.col("high"))
    near = weak.join(reach, [*key, "cell"]).withColumn("at", at).where("at IS NOT NULL")
    met = near.groupBy(*key, "span", "role").agg(F.min("at").alias("at"))
    met = met.groupBy(*key, "span").agg(F.collect_set("role").alias("roles"), F.sort_array(F.collect_list(F.struct("role", "at"))).alias("parts"))
    enough = F.lit(False)
    for kind, roles in NEEDS.items():
        has = F.lit(True)
        for role in roles:
            has = has & F.array_contains("roles", role)
        enough = enough | ((F.col("span.rank") == KINDS.index(kind)) & has)
    own = F.get(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("span.rank"))
    link = F.struct("span.start", "span.rank", "span.end", F.filter("parts", lambda x: x["role"] != own).alias("parts"))
    return met.where(enough).groupBy(*key).agg(F.sort_array(F.collect_list(link)).alias("_weak"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``base``, ``spans`` and ``links`` appended, sorted arrays.

    ``base`` and ``spans`` hold (start, rank of kind, end); ``links`` holds the
    weak spans among these, each with the ``parts`` (role, start) of the credential
    it completes, one of each role. A null text is an empty one, without spans. Offsets count code points, ends
    are exclusive. Repeated rows are scanned and reported each; other columns
    are kept, and columns named like the results are replaced. Texts are joined
    with their weak candidates by two hashes of the whole text, so the frame
    needs no key of its own.
    """
    key = ["_h1", "_h2"]
    own, text_name = kernel.shielded(docs, text_col)
    kept = [c for c in docs.columns if c not in ("base", "spans", "links")]
    text = F.coalesce(F.col(text_name), F.lit(""))
    hashed = own.withColumns({"_h1": F.xxhash64(text), "_h2": F.crc32(text)})
    base = hashed.withColumn("_base", F.sort_array(F.concat(*[_spans(text, k) for k in STRONG])))
    weak = _linked(hashed.select(text_name, *key).where(F.col(text_name).isNotNull()), text_name, key)
    out = base.join(small(weak, FEW), key, "left")
    links = F.coalesce("_weak", F.array().cast(_LINK))
    linked = F.transform(links, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    names = [f"_own{docs.columns.index(c)}" for c in kept]
    return out.select(*names, "_base", F.sort_array(F.concat("_base", linked)), links).toDF(*kept, "base", "spans", "links")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[redacted]") -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by ``mark``.

    Other columns are the caller's own, whatever they are named. A null text
    stays null, an empty one empty; repeated rows are each redacted.
    """
    own, text_name = kernel.shielded(docs, text_col)
    out = scan(own, text_name)

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(s["start"].alias("start"), acc["at"].alias("before"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    # where each span starts, and where all before it have ended
    shift = lambda o, at: F.struct(o["start"].alias("start"), F.greatest(o["before"], at).alias("before"))
    run = _running(F.col("spans"), -1, "array<struct<start:bigint,before:bigint>>", step, lambda at, more: F.greatest(at, more), shift)
    text = F.col(text_name)

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE), F.floor(end / PIECE)
        return F.substring(F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))

    def marked(r: Column, pieces: Column) -> Column:
        alone = F.filter(r["out"], lambda o: o["start"] > o["before"])
        gaps = F.transform(alone, lambda o: F.concat(cut(pieces, F.greatest(o["before"], F.lit(0)), o["start"]), F.lit(mark)))
        return F.concat(F.array_join(gaps, ""), cut(pieces, r["at"], F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = F.when(F.size("spans") == 0, text).otherwise(_let(run, lambda r: _let(pieces, lambda p: marked(r, p))))
    return out.withColumn(text_name, clean).select(*own.columns).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the strong kinds, base_sha256, spans, and links (span<role@start+role@start of its parts)."""
    out = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[n(k) for k in STRONG], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), _told(F.col("links")).alias("links")
    )
