"""Secrets in texts: fixed patterns, and tokens that a battery of tests finds random.

Everything is column expressions in one pass over the texts; only counts per
encoding, length and test result are gathered, to set the thresholds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in the order of their names in a tie.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
PLACEHOLDER = "[SECRET]"

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# what stands between - and _ in a token, so without its prefix, is judged too
SEPARATOR = "[_-]"
LEAST = 20
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# An encoding is inferred from the characters a token has: the first, so the
# smallest, whose alphabet holds them all. Whether they are spread evenly over it
# is left to the tests.
ENCODINGS = [
    ("hex", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base32_lower", LOWER + "234567"),
    ("base36_upper", DIGITS + UPPER),
    ("base36", DIGITS + LOWER),
    ("letters", UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
]
# Long words also are letters only, and too short for their uneven spread to show:
# letters count only if even odds are likelier than those of prose, a to z per
# mille (mean of English, German, French and Spanish), by this factor.
ONLY_LETTERS = ("lower", "upper", "letters")
PROSE = (86, 16, 33, 46, 143, 14, 19, 31, 69, 4, 6, 46, 29, 78, 63, 19, 6, 68, 75, 69, 41, 12, 11, 2, 8, 5)
LIKELIER = 20
FALSE_DISCOVERIES = 0.05
BINS = 100
SPAN = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 64  # spans that are put together at once; longer lists are put together from blocks


def _places(matches: str, gaps: str, kind: int) -> Column:
    """Spans of the matches, in code points, from the stretches of text between them.

    A list that grows by one is copied, so it grows by blocks: the work is in proportion to the matches.
    """
    found = f"arrays_zip(transform({matches}, m -> length(m)), transform(slice({gaps}, 1, size({matches})), g -> length(g)))"
    return F.expr(
        f"""transform(array({found}), found -> aggregate(
          sequence(0, (size(found) - 1) div {BLOCK}),
          named_struct('at', 0, 'blocks', cast(array() as array<{SPAN}>)),
          (a, b) -> transform(array(aggregate(
              slice(found, b * {BLOCK} + 1, {BLOCK}),
              named_struct('at', a.at, 'spans', cast(array() as {SPAN})),
              (x, f) -> named_struct('at', x.at + f['0'] + f['1'], 'spans', concat(x.spans, array(named_struct(
                'start', x.at + f['1'], 'kind', {kind}, 'end', x.at + f['0'] + f['1'])))))),
            x -> named_struct('at', x.at, 'blocks', concat(a.blocks, array(x.spans))))[0],
          a -> flatten(a.blocks)))[0]"""
    )


def _matched(df: DataFrame, name: str, pattern: str, kind: int) -> DataFrame:
    """Adds ``name``: the spans of all matches, and ``name``_text: the matches."""
    df = df.withColumn(f"{name}_text", F.regexp_extract_all("scan_text", F.lit(pattern), F.lit(0)))
    some = F.size(f"{name}_text") > 0
    df = df.withColumn(f"{name}_gaps", F.when(some, F.split("scan_text", pattern, -1)))
    return df.withColumn(name, F.when(some, _places(f"{name}_text", f"{name}_gaps", kind)).otherwise(F.array().cast(SPAN)))


def _tests(df: DataFrame) -> DataFrame:
    """Adds ``judged``: span, encoding, length band and p-value of every token, and part of one, with an encoding.

    p is the chance that a uniformly random token of the alphabet fares worse:
    chi-squared of the character counts, runs above and below the middle of the
    alphabet, and the correlation of neighbours, joined by Fisher's method.
    """
    cases = ""
    for i, (_, alphabet) in enumerate(ENCODINGS):
        fits = f"^[{alphabet}]+$".replace("-_", "_-")
        cases += f" when rlike(t.token, '{fits}') then {i}"
    alphabets = "array(" + ", ".join(f"'{a}'" for _, a in ENCODINGS) + ")"
    letters = ", ".join(str(i) for i, (name, _) in enumerate(ENCODINGS) if name in ONLY_LETTERS)
    odds = "array(" + ", ".join(f"{math.log(sum(PROSE) / 26 / x):.3f}D" for x in PROSE) + ")"
    normal = "(1 / (1 + exp(1.5976 * {z} + 0.07056 * {z} * {z} * {z})))"
    steps = [
        # a list is zipped with another, never looked up in it: inside a lambda the other would be made anew each time
        ("tokens", "transform(arrays_zip(token, token_text), t -> struct(t.token_text as token, t.token as span, t.token.start as of, true as whole))"),
        (
            "parts",
            f"transform(filter(tokens, t -> rlike(t.token, '{SEPARATOR}')), t -> filter(aggregate(split(t.token, '{SEPARATOR}', -1),"
            " named_struct('at', t.of, 'parts', cast(array() as array<struct<token:string,span:struct<start:int,kind:int,end:int>,of:int,whole:boolean>>)),"
            " (a, x) -> named_struct('at', a.at + length(x) + 1, 'parts', concat(a.parts, array(named_struct('token', x,"
            " 'span', named_struct('start', a.at, 'kind', 3, 'end', a.at + length(x)), 'of', t.of, 'whole', false)))),"
            f" a -> a.parts), x -> length(x.token) >= {LEAST}))",
        ),
        ("tokens", "concat(tokens, flatten(parts))"),
        # the characters of the base kinds hex and access are those of tokens, so a token that touches one holds all of it
        ("tokens", f"filter(tokens, t -> not rlike(t.token, '{HEX}|{ACCESS}'))"),
        ("tokens", f"transform(tokens, t -> struct(t.token, t.span, t.of, t.whole, case{cases} end as encoding))"),
        ("tokens", "filter(tokens, t -> t.encoding is not null)"),
        ("tokens", f"transform(tokens, t -> struct(t.span, t.of, t.whole, t.encoding, length(t.token) as n, element_at({alphabets}, t.encoding + 1) as alphabet, t.token))"),
        (
            "tokens",
            "transform(tokens, t -> struct(t.span, t.of, t.whole, t.encoding, cast(t.n as double) as n, cast(length(t.alphabet) as double) as a,"
            " transform(slice(split(t.token, ''), 1, t.n), c -> instr(t.alphabet, c) - 1) as codes))",
        ),
        (
            "tokens",
            f"filter(tokens, t -> t.encoding not in ({letters})"
            f" or aggregate(t.codes, 0D, (s, c) -> s + element_at({odds}, cast(c % 26 as int) + 1)) >= ln({LIKELIER}))",
        ),
        (
            "tokens",
            "transform(tokens, t -> struct(t.span, t.of, t.whole, t.encoding, t.n,"
            " (aggregate(sequence(0, cast(t.a as int) - 1), 0D, (s, v) -> s + pow(size(filter(t.codes, c -> c = v)), 2)) * t.a / t.n - t.n - (t.a - 1))"
            "   / sqrt(2 * (t.a - 1) * (t.n - 1) / t.n) as z_uniform,"
            " (aggregate(sequence(1, size(t.codes) - 1), 0D, (s, i) -> s + if((t.codes[i] * 2 >= t.a) <> (t.codes[i - 1] * 2 >= t.a), 1, 0)) - (t.n - 1) / 2)"
            "   / sqrt((t.n - 1) / 4) as z_runs,"
            " aggregate(sequence(1, size(t.codes) - 1), 0D, (s, i) -> s + (t.codes[i] - (t.a - 1) / 2) * (t.codes[i - 1] - (t.a - 1) / 2))"
            "   / ((t.a * t.a - 1) / 12 * sqrt(t.n - 1)) as z_serial))",
        ),
        (
            "tokens",
            "transform(tokens, t -> struct(t.span, t.of, t.whole, t.encoding, t.n,"
            f" -2 * (ln(greatest(1e-12, {normal.format(z='t.z_uniform')}))"
            f" + ln(greatest(1e-12, 2 * {normal.format(z='abs(t.z_runs)')}))"
            f" + ln(greatest(1e-12, 2 * {normal.format(z='abs(t.z_serial)')}))) as x))",
        ),
        (
            "judged",
            "transform(tokens, t -> struct(t.span.start as start, t.span.end as end, t.of, t.whole, t.encoding, cast(floor(2 * log2(t.n / 20)) as int) as band,"
            " least(1D, exp(-t.x / 2) * (1 + t.x / 2 + t.x * t.x / 8)) as p))",
        ),
    ]
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.drop("tokens", "parts")


def _scanned(docs: DataFrame, base: bool = True) -> DataFrame:
    df = docs.withColumn("scan_text", F.coalesce("text", F.lit("")))
    if base:
        df = _matched(df, "assign", ASSIGN, 0)
        df = df.withColumn("assign_value", F.regexp_extract_all("scan_text", F.lit(ASSIGN), F.lit(2)))
        long = f"filter(arrays_zip(assign, assign_value), x -> length(x.assign_value) >= {ASSIGN_LEAST})"
        df = df.withColumn("assign", F.expr(f"transform({long}, x -> x.assign)"))
        df = _matched(df, "access", ACCESS, 1)
        df = _matched(df, "hex", HEX, 2)
        df = df.withColumn("base", F.expr("array_sort(concat(assign, access, hex))"))
    return _tests(_matched(df, "token", TOKEN, 3))


def thresholds(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> dict[tuple[int, int], float]:
    """Least p-value that counts as random, per encoding and length band, from all of ``docs``.

    Random tokens have evenly spread p-values, so twice those above one half tell
    how many random ones there are; what lies above a threshold beyond their part
    is a false discovery. The threshold is the lowest at which these are at most
    the given share. Bands are judged apart, since short tokens tell less.
    """
    rows = (
        _scanned(docs.select("text"), base=False)
        .select(F.explode("judged").alias("t"))
        .groupBy("t.encoding", "t.band", F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    counts: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        counts.setdefault((r["encoding"], r["band"]), [0] * BINS)[r["bin"]] = r["n"]
    found = {}
    for stratum, n in counts.items():
        above = [sum(n[b:]) for b in range(BINS + 1)]
        half = above[BINS // 2]
        for b in range(1, BINS // 2 + 1):
            false = max(0.0, above[b] - 2 * half * (1 - b / BINS))
            if false <= false_discoveries * above[b]:
                found[stratum] = b / BINS
                break
    return found


def find_secrets(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with base, random and spans: arrays of (start, end, kind), in code points, end exclusive.

    ``kind`` counts KINDS from 0. Random tokens that touch a base span add
    nothing and are left out, as are random parts of random tokens. A null or empty text has no spans; an empty table
    gives no rows; each row is judged by itself, so repeated rows repeat.
    """
    limits = thresholds(docs, false_discoveries)
    table = "map(" + ", ".join(f"'{e}:{b}', {t}D" for (e, b), t in sorted(limits.items())) + ")" if limits else "cast(map() as map<string,double>)"
    # the whole row travels in one column, so no name of it can clash
    df = _scanned(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    df = df.withColumn(
        "judged",
        F.expr(
            f"""filter(judged, t -> t.p >= coalesce({table}[concat(t.encoding, ':', t.band)], 2D)
              and not exists(assign, b -> b.start < t.end and t.start < b.end))"""
        ),
    )
    # the places of random tokens; parts of these add nothing
    df = df.withColumn("whole", F.expr("transform(filter(judged, t -> t.whole), t -> t.start)"))
    df = df.withColumn(
        "random",
        F.expr(
            """transform(filter(judged, t -> t.whole or not array_contains(whole, t.of)),
              t -> named_struct('start', t.start, 'kind', 3, 'end', t.end))"""
        ),
    )
    return df.select("row", "text", "assign", "access", "hex", "base", "random", F.expr("array_sort(concat(base, random))").alias("spans"))


def spans_text(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and the number of random ones."""
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
        F.size("random").cast("bigint").alias("n_random"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by PLACEHOLDER; n_chars, if there is such a column, follows the text.

    Null and empty texts stay as they are, repeated rows are treated each for itself, and an empty table stays empty.
    """
    found = find_secrets(docs)
    cleaned = F.expr(
        f"""aggregate(sequence(0, (size(spans) - 1) div {BLOCK}), named_struct('at', 0, 'out', cast(array() as array<string>)),
          (a, b) -> transform(array(slice(spans, b * {BLOCK} + 1, {BLOCK})), some ->
            transform(array(substr(text, a.at + 1, greatest(0, array_max(transform(some, s -> s.end)) - a.at))), piece ->
              transform(array(aggregate(some, named_struct('at', a.at, 'out', ''),
                (x, s) -> named_struct('at', greatest(x.at, s.end), 'out',
                  if(s.start >= x.at, concat(x.out, substr(piece, x.at - a.at + 1, s.start - x.at), '{PLACEHOLDER}'), x.out)))),
                x -> named_struct('at', x.at, 'out', concat(a.out, array(x.out))))[0])[0])[0],
          a -> concat(array_join(a.out, ''), substr(text, a.at + 1)))"""
    )
    found = found.withColumn("new_text", F.when(F.size("spans") > 0, cleaned).otherwise(F.col("text")))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.size("spans") > 0, F.length("new_text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return found.select(*out)
