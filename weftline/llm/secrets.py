"""Secret scans: three base patterns, and a battery of randomness tests under false-discovery control.

Only DataFrame functions and SQL expressions, over whole texts. Runs of 20 or more key characters are candidates.
For each, an encoding is inferred (hexadecimal, base 32, letters and digits, base 64); a chi-squared test of
uniform use of its alphabet, a runs test about the alphabet's middle and a lag-1 serial correlation test must not
reject randomness. Short text may look random too, so each candidate also gets the probability that text would be
as even: the characters of all shorter runs of the corpus give what chi-squared to expect of text of that
length, and Benjamini and Hochberg's rule within classes of length (by powers of two) bounds the share of text
among what is reported. Distinct candidates count once; what reaches the driver is a histogram of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As the first 20 and 24 characters can only lie in one greedy run, asking for them in the pattern drops the same matches.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
CANDIDATE, BACKGROUND = r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+/_-]{8,19}"
KINDS = ("assign", "access", "hex", "random")
#: Share of false discoveries, level of the randomness tests, steps of the histogram to a decade, its last decade.
FALSE_SHARE, LEVEL, STEPS, DECADES = 0.01, 0.001, 20, 15

_upper, _lower, _digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: In the order of inference: the first alphabet that holds all characters.
ALPHABETS = (_digits + "abcdef", _digits + "ABCDEF", _upper + "234567", _upper + _digits, _lower + _digits, _upper + _lower + _digits, _upper + _lower + _digits + "+/", _upper + _lower + _digits + "-_")


def _normal_cdf(z: str) -> str:
    """The normal distribution function by a logistic curve of odd cubic argument; off by 0.00014 at most."""
    return f"(1 / (1 + exp(-(({z}) * (1.5976 + 0.070565992 * ({z}) * ({z}))))))"


def _two_sided(z: str) -> str:
    return f"(2 * {_normal_cdf(f'-abs({z})')})"


def _starts(lengths: str) -> str:
    """Sums of all earlier elements, for each element of an array of numbers; in chunks, so that no array grows quadratically."""
    prefix = "aggregate({0}, named_struct('sum', 0L, 'all', cast(array() as array<bigint>)), (a, v) -> named_struct('sum', a.sum + v, 'all', array_append(a.all, a.sum)))"
    chunks = f"transform(sequence(0, (size({lengths}) - 1) div 256), c -> slice({lengths}, c * 256 + 1, 256))"
    inner = f"transform({chunks}, part -> {prefix.format('part')})"
    return f"transform(array({inner}), inner -> flatten(zip_with(inner, {prefix.format('transform(inner, x -> x.sum)')}.all, (x, o) -> transform(x.all, s -> s + o))))[0]"


def _found(df: DataFrame, name: str, pattern: str, gate: Column | None = None) -> DataFrame:
    """Adds an array of the pattern's leftmost matches with their start and end in code points.

    Matches and the pieces between them alternate; the starts are sums of their lengths.
    """
    none = F.array().cast("array<string>")
    matched = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    df = df.withColumn("_m", matched if gate is None else F.when(gate, matched).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)))
    df = df.withColumn("_steps", F.when(F.size("_m") > 0, F.expr("zip_with(_m, slice(_gaps, 1, size(_m)), (m, g) -> cast(length(m) + length(g) as bigint))")))
    df = df.withColumn("_before", F.when(F.size("_m") > 0, F.expr(_starts("_steps"))))
    spans = "transform(arrays_zip(_before, _gaps_of, _m), z -> named_struct('at', z._before + length(z._gaps_of), 'end', z._before + length(z._gaps_of) + length(z._m), 'match', z._m))"
    df = df.withColumn("_gaps_of", F.when(F.size("_m") > 0, F.expr("slice(_gaps, 1, size(_m))")))
    empty = "cast(array() as array<struct<at: bigint, end: bigint, match: string>>)"
    df = df.withColumn(name, F.coalesce(F.expr(f"CASE WHEN size(_m) > 0 THEN {spans} END"), F.expr(empty)))
    return df.drop("_m", "_gaps", "_steps", "_before", "_gaps_of")


def _alphabet(token: str) -> str:
    """The inferred alphabet as an SQL expression; null for characters of no one encoding."""
    cases = " ".join(f"WHEN translate({token}, '{a}', '') = '' THEN '{a}'" for a in ALPHABETS)
    return f"CASE {cases} END"


@dataclass(frozen=True)
class TextModel:
    """For each alphabet, sum((q - 1/k)^2) * k, sum(q^2) and sum(q^3) of the characters' shares q in ordinary runs."""

    moments: dict[str, tuple[float, float, float]]

    def sql(self, alphabet: str, which: int) -> str:
        return f"CASE {alphabet} " + " ".join(f"WHEN '{a}' THEN {m[which]!r}D" for a, m in self.moments.items()) + " END"


def text_model(docs: DataFrame) -> TextModel:
    """Counts the characters of all runs of 8 to 19 key characters in all texts; 64 rows at most come back."""
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(BACKGROUND), F.lit(0))).alias("run"))
    rows = runs.select(F.explode(F.split("run", "")).alias("c")).groupBy("c").count().collect()
    n = {r["c"]: r["count"] for r in rows}
    moments = {}
    for a in ALPHABETS:
        own = [n.get(c, 0) + 1 for c in a]
        q = [x / sum(own) for x in own]
        moments[a] = (sum((x - 1 / len(a)) ** 2 for x in q) * len(a), sum(x * x for x in q), sum(x**3 for x in q))
    return TextModel(moments)


def _tested(tokens: str, model: TextModel) -> str:
    """An array of candidates, each with n, p_random (the least of three, times three) and p_text, as an SQL expression.

    ``tokens`` is an array of structs with a field ``match``; candidates of no encoding are left out.
    """
    s = f"filter(transform({tokens}, x -> named_struct('x', x, 'core', x.match, 'alphabet', {_alphabet('x.match')})), x -> x.alphabet IS NOT NULL)"
    s = f"transform({s}, x -> named_struct('x', x.x, 'core', x.core, 'alphabet', x.alphabet, 'n', cast(length(x.core) as double), 'k', length(x.alphabet), 'i', transform(split(x.core, ''), c -> cast(locate(c, x.alphabet) - 1 as double))))"
    squares = "aggregate(sequence(1, x.k), 0D, (a, j) -> a + pow(x.n - length(replace(x.core, substring(x.alphabet, j, 1), '')), 2))"
    ups = "aggregate(x.i, 0D, (a, v) -> a + if(v * 2 >= x.k, 1, 0))"
    runs = "aggregate(sequence(1, cast(x.n as int) - 1), 1D, (a, j) -> a + if((x.i[j] * 2 >= x.k) = (x.i[j - 1] * 2 >= x.k), 0, 1))"
    s = f"transform({s}, x -> named_struct('x', x.x, 'alphabet', x.alphabet, 'n', x.n, 'k', cast(x.k as double), 'i', x.i, 'chi', ({squares}) * x.k / x.n - x.n, 'mean', aggregate(x.i, 0D, (a, v) -> a + v) / x.n, 'up', {ups}, 'runs', {runs}))"
    spread = "aggregate(x.i, 0D, (a, v) -> a + (v - x.mean) * (v - x.mean))"
    serial = "aggregate(sequence(1, cast(x.n as int) - 1), 0D, (a, j) -> a + (x.i[j] - x.mean) * (x.i[j - 1] - x.mean))"
    both = "(2 * x.up * (x.n - x.up))"
    s = f"transform({s}, x -> named_struct('x', x.x, 'alphabet', x.alphabet, 'n', x.n, 'k', x.k, 'chi', x.chi, 'serial', {serial} / nullif({spread}, 0D), 'runs_gap', x.runs - {both} / x.n - 1, 'runs_var', {both} * ({both} - x.n) / (x.n * x.n * (x.n - 1))))"
    even = "(pow(greatest(x.chi, 0D) / (x.k - 1), 1D / 3) - (1 - 2 / (9 * (x.k - 1)))) / sqrt(2 / (9 * (x.k - 1)))"
    p_chi, p_runs = f"(1 - {_normal_cdf(even)})", _two_sided("x.runs_gap / sqrt(x.runs_var)")
    p_serial = _two_sided("(x.serial + 1 / x.n) * sqrt(x.n)")
    p_random = f"least(1D, 3 * least({p_chi}, if(x.runs_var > 0, {p_runs}, 0D), coalesce({p_serial}, 0D)))"
    apart, q2, q3 = (model.sql("x.alphabet", j) for j in range(3))
    text_mean = f"(x.k - 1 + (x.n - 1) * ({apart}))"
    text_sd = f"sqrt(2 * (x.k - 1) + 4 * x.n * x.k * x.k * greatest(0D, ({q3}) - ({q2}) * ({q2})))"
    p_text = f"greatest(1e-{DECADES}, {_normal_cdf(f'(x.chi - {text_mean}) / {text_sd}')})"
    return f"transform({s}, x -> named_struct('at', x.x.at, 'end', x.x.end, 'n', x.n, 'p_random', {p_random}, 'p_text', {p_text}))"


_CLASS, _BIN = "cast(floor(log2(n)) as int)", f"cast(ceil(log10(p_text) * {STEPS}) as int)"


def cutoffs(docs: DataFrame, model: TextModel, false_share: float = FALSE_SHARE) -> dict[int, float]:
    """For each class of length, the largest p_text that Benjamini and Hochberg's rule accepts.

    p is rounded up to a twentieth of a decade, which errs on the safe side; a few thousand counts come back.
    """
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("match")).distinct()
    tested = tokens.select(F.explode(F.expr(_tested("array(named_struct('at', 0L, 'end', 0L, 'match', match))", model))).alias("t")).select("t.*")
    rows = tested.groupBy(F.expr(_CLASS).alias("class"), F.expr(_BIN).alias("bin")).count().collect()
    found = {}
    for c in {r["class"] for r in rows}:
        own = sorted((r["bin"], r["count"]) for r in rows if r["class"] == c)
        total, so_far = sum(n for _, n in own), 0
        for b, n in own:
            so_far += n
            if 10 ** (b / STEPS) <= false_share * so_far / total:
                found[c] = 10 ** (b / STEPS)
    return found


def with_spans(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """All columns of documents, ``_text`` (null: empty), and ``_spans``: (at, rank, end) in order of start and kind.

    rank numbers KINDS. A random span overlaps no base span.
    """
    model = text_model(docs)
    cuts = cutoffs(docs, model, false_share)
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    low = F.lower("_text")
    key = F.contains(low, F.lit("key")) & F.contains(low, F.lit("api"))
    gate = F.contains(low, F.lit("password")) | F.contains(low, F.lit("passwd")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | key
    df = _found(df, "_assign", ASSIGN, gate)
    # a match ends with its value, so the value's length is that of the longest tail of value characters after the sign
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= LEAST_ASSIGNED))
    df = _found(df, "_access", ACCESS, F.contains("_text", F.lit("AKIA")))
    df = _found(df, "_hex", HEX)
    df = _found(df, "_candidate", CANDIDATE)
    cut = "CASE " + " ".join(f"WHEN {_CLASS.replace('(n)', '(x.n)')} = {c} THEN {p!r}D" for c, p in sorted(cuts.items())) + " ELSE -1D END" if cuts else "-1D"
    kept = f"filter({_tested('_candidate', model)}, x -> x.p_random >= {LEVEL} AND x.p_text <= {cut})"
    df = df.withColumn("_random", F.when(F.size("_candidate") > 0, F.expr(kept)))
    base = [f"transform(_{kind}, x -> named_struct('at', x.at, 'rank', {rank}, 'end', x.end))" for rank, kind in enumerate(KINDS[:3])]
    df = df.withColumn("_base", F.expr(f"concat({', '.join(base)})"))
    free = "transform(filter(coalesce(_random, array()), x -> NOT exists(_base, b -> b.at < x.end AND x.at < b.end)), x -> named_struct('at', x.at, 'rank', 3, 'end', x.end))"
    df = df.withColumn("_spans", F.expr(f"array_sort(concat(_base, {free}))"))
    return df.drop("_candidate", "_random", "_base")


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.rank], ':', x.at, ':', x.end)), ',')")


def scan_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    Null and empty texts have no spans; very long texts and very long runs are taken whole; repeated rows give equal
    rows, a null doc_id is returned; spans that start together stand in the order of KINDS, of candidates with equal
    p-values all or none are reported. An empty table gives no rows. Of other columns none is read.
    """
    df = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), false_share)
    return df.select(
        "doc_id",
        *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined("filter(_spans, x -> x.rank < 3)"), 256).alias("base_sha256"),
        _joined("_spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """The documents, in their own columns, with each secret's characters replaced; n_chars, if there, follows.

    Overlapping spans are replaced as one. Texts without secrets and null texts stay as they are.
    """
    # the row travels as one struct, so that no column of it can clash with those of the scan
    df = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), false_share)
    step = f"if(x.at < a.to, named_struct('to', greatest(a.to, x.end), 'out', a.out), named_struct('to', x.end, 'out', concat(a.out, substring(_text, cast(a.to as int) + 1, cast(x.at - a.to as int)), '{mark}')))"
    text = F.expr(f"aggregate(_spans, named_struct('to', 0L, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(_text, cast(a.to as int) + 1)))")
    df = df.withColumn("text", F.when(F.size("_spans") > 0, text).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return df.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
