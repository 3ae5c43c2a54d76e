"""Secret scan: fixed formats, and sliding-window Shannon entropy per character class. DataFrame functions only.

Cases: null and empty texts have no spans (digest of the empty string). Every input row gives one output row, repeated rows
included. Columns other than doc_id and text are ignored. Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The fixed formats, in the order in which ties are listed. For runs of one class, a lower bound inside the pattern drops
#: the same matches as a later test would; for an assignment it would not, so its value is measured afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_base64", "entropy_hex")

#: Candidate strings per character class: (kind, pattern, least entropy in bits of some window).
CLASSES = (("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 3.8), ("entropy_hex", r"[0-9A-Fa-f]{20,}", 3.2))
WINDOW = 20
#: Candidates that look random but are known to be harmless: numbers, UUIDs, words chained by a separator, alphabets, fillers.
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[/_=-]*[A-Za-z]+([/_=-]+[A-Za-z]+)+[/_=-]*$",
    r"(?i)abcdefghijklm|nopqrstuvwxyz|0123456789|qwertyuiop",
    r"(?i)example|placeholder|dummy|sample|changeme",
)

_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _located(gaps: str, hits: str, kind: int) -> Column:
    """Spans of all hits from the texts between and in them."""
    add = f"char_length(element_at({hits}, i))"
    at = f"s.pos + char_length(element_at({gaps}, i))"
    return F.expr(
        f"""CASE WHEN size({hits}) > 0 THEN aggregate(sequence(1, size({hits})),
        named_struct('pos', 0, 'out', CAST(array() AS {_SPANS})),
        (s, i) -> named_struct('pos', {at} + {add}, 'out', concat(s.out, array(named_struct('start', {at}, 'kind', {kind}, 'stop', {at} + {add})))),
        s -> s.out) ELSE CAST(array() AS {_SPANS}) END"""
    )


def _hot(chars: str, window: int, least: float) -> str:
    """SQL: struct(first, last) of the windows of a candidate whose entropy reaches least; last is -1 if none does.

    One pass. cnt holds the counts of the window's characters and total the sum of c * log2(c); a step adds the entering
    character and takes off the leaving one, so the entropy log2(window) - total / window follows without a recount.
    """
    g = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 2)) + ")"
    cin = f"ascii(element_at({chars}, i))"
    out = f"(CASE WHEN i > {window} THEN ascii(element_at({chars}, i - {window})) ELSE -1 END)"
    step = f"""named_struct('cin', {cin}, 'out', {out})"""
    less = f"(CASE WHEN p.out < 0 OR p.out = p.cin THEN 0D ELSE element_at({g}, element_at(s.cnt, p.out)) - element_at({g}, element_at(s.cnt, p.out) + 1) END)"
    more = f"(CASE WHEN p.out = p.cin THEN 0D ELSE element_at({g}, element_at(s.cnt, p.cin) + 2) - element_at({g}, element_at(s.cnt, p.cin) + 1) END)"
    counted = "(CASE WHEN p.out = p.cin THEN s.cnt ELSE transform(s.cnt, (c, k) -> c + CAST(k + 1 = p.cin AS INT) - CAST(k + 1 = p.out AS INT)) END)"
    test = f"(p.i >= {window} AND round({math.log2(window)!r}D - (s.total + {less} + {more}) / {window}, 9) >= {least}D)"
    steps = f"transform(sequence(1, size({chars})), i -> named_struct('i', i, 'cin', {cin}, 'out', {out}))"
    return f"""aggregate({steps},
        named_struct('cnt', array_repeat(0, 127), 'total', 0D, 'first', -1, 'last', -1),
        (s, p) -> named_struct('cnt', {counted}, 'total', s.total + {less} + {more},
            'first', CASE WHEN s.first < 0 AND {test} THEN p.i - {window} ELSE s.first END,
            'last', CASE WHEN {test} THEN p.i ELSE s.last END),
        s -> named_struct('first', s.first, 'last', s.last))"""


def _entropic(hits: str, spans: str, kind: int, window: int, least: float, allowed: tuple[str, ...]) -> Column:
    """Spans from the first to the end of the last window over the bound, of candidates that no allowed pattern matches."""
    harmless = " OR ".join("rlike(h, r'%s')" % a.replace("'", "") for a in allowed) or "false"
    return F.expr(
        f"""CASE WHEN size({hits}) > 0 THEN filter(zip_with({hits}, {spans}, (h, at) ->
            CASE WHEN {harmless} THEN NULL ELSE transform(array({_hot("split(h, '')", window, least)}), w ->
                CASE WHEN w.last < 0 THEN NULL ELSE named_struct('start', at.start + w.first, 'kind', {kind}, 'stop', at.start + w.last) END)[0] END),
            x -> x IS NOT NULL) ELSE CAST(array() AS {_SPANS}) END"""
    )


def scan_secrets(docs: DataFrame, text: str = "text", window: int = WINDOW, classes: tuple = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with `base` and `found`: arrays of struct(start, kind, stop), kind an index of KINDS, sorted.

    base has the fixed formats; found adds high-entropy stretches that no base span contains.
    """
    t = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    low = F.lower("__t")
    cued = F.lit(False)
    for cue in ("passw", "secret", "token", "api"):
        cued = cued | low.contains(cue)
    none = F.array().cast("array<string>")
    t = t.withColumn("__cued", cued).withColumn("__akia", F.col("__t").contains("AKIA"))

    def hits(pattern: str, group: int, when: Column | None) -> Column:
        found = F.regexp_extract_all("__t", F.lit(pattern), F.lit(group))
        return found if when is None else F.when(when, found).otherwise(none)

    def gaps(of: str, pattern: str) -> Column:
        return F.when(F.size(of) > 0, F.split("__t", pattern, -1)).otherwise(none)

    t = t.withColumns({"__h0": hits(ASSIGN, 0, F.col("__cued")), "__v0": hits(ASSIGN, 2, F.col("__cued")), "__h1": hits(ACCESS, 0, F.col("__akia")), "__h2": hits(HEX, 0, None)})
    t = t.withColumns({f"__h{3 + i}": hits(c[1], 0, None) for i, c in enumerate(classes)})
    patterns = [ASSIGN, ACCESS, HEX, *(c[1] for c in classes)]
    t = t.withColumns({f"__g{i}": gaps(f"__h{i}", p) for i, p in enumerate(patterns)})
    t = t.withColumns({f"__s{i}": _located(f"__g{i}", f"__h{i}", i) for i in range(len(patterns))})
    t = t.withColumn("__s0", F.expr(f"filter(__s0, (x, i) -> char_length(element_at(__v0, i + 1)) >= {ASSIGN_LEAST})"))
    t = t.withColumn("base", F.array_sort(F.concat("__s0", "__s1", "__s2")))
    added = [_entropic(f"__h{3 + i}", f"__s{3 + i}", 3 + i, window, c[2], allowed) for i, c in enumerate(classes)]
    t = t.withColumn("__new", F.concat(*added))
    t = t.withColumn("found", F.expr("array_sort(concat(base, filter(__new, e -> NOT exists(base, b -> b.start <= e.start AND e.stop <= b.stop))))"))
    return t.drop("__t", "__cued", "__akia", "__v0", "__new", *[f"__{k}{i}" for k in "hgs" for i in range(len(patterns))])


def listed(spans: str) -> Column:
    """kind:start:stop, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.kind], x.start, x.stop)), ',')")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS BIGINT)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))
