"""Secret scan (native): fixed patterns, and sliding-window Shannon entropy over candidate strings.

Entropy is taken per character class (hexadecimal, lower-case base 36, base 64) over windows of WINDOW
characters. Counts are incremental: a step changes the sum of ``count * log2(count)`` by the entering character's
and the leaving one's terms, whose counts come from the window's characters alone. Windows at or over the class's limit
are joined to spans of kind ``entropy``. Windows that overlap a harmless word, spans that lie in a base span, and
candidates on the allow-list are not reported.

All work is in proportion to the text: arrays that grow (matches, windows) are made in chunks of CHUNK.

Defined results: null or empty text has no spans (counts 0, the hash of nothing); texts and candidates of any length
are scanned whole; a null doc_id is kept; repeated rows give repeated results; spans with an equal start go by kind;
an empty table gives an empty result; other columns, whatever their names, are ignored, and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Kinds and patterns of the base scan, in report order. Fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy leftmost runs of at least so many characters are just the runs that are long enough.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Bits a character that a window needs, by class.
LIMITS = {"hex": 2.9, "base36": 3.6, "base64": 3.75}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Candidates that match one of these are known to be harmless.
ALLOWED = [
    r"^[A-Za-z/_-]+$",  # words, paths and names without a digit
    r"^[0-9/_+-]+$",  # numbers, dates and telephone numbers
    r"^[A-Z]?[a-z]+[0-9]{1,4}$",  # a word with a number
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^([A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}$",  # a path or slug that ends in a number
]
#: Parts of candidates that are harmless, and so are the windows that overlap them.
HARMLESS = r"(?i)(?:example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefghij)"
CHUNK = 256
KINDS = ["assign", "access", "hex", "entropy"]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _bound(value: str, name: str, then: str) -> str:
    """SQL for ``then``, in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _chunks(array: str) -> str:
    """SQL for an array cut in arrays of CHUNK."""
    return f"transform(sequence(0, (size({array}) - 1) div {CHUNK}), k_ -> slice({array}, k_ * {CHUNK} + 1, {CHUNK}))"


def _scan(numbers: str, joined: str = "{} + {}") -> str:
    """SQL for what ``joined`` makes of all numbers before each of an array, 0 at first: within chunks, then over the chunks."""
    one = lambda array, number: f"aggregate({array}, named_struct('at', 0, 'out', cast(array() as array<int>)), (a_, x_) -> named_struct('at', {joined.format('a_.at', number)}, 'out', array_append(a_.out, a_.at)))"
    local = _bound(numbers, "l_", f"transform({_chunks('l_')}, c_ -> {one('c_', 'x_')})")
    return _bound(local, "p_", f"flatten(zip_with(p_, {one('p_', 'x_.at')}.out, (y_, b_) -> transform(y_.out, z_ -> {joined.format('z_', 'b_')})))")


def _spans(text: str, pattern: str, least: tuple[int, int] | None = None) -> str:
    """SQL for an array of (s, e, v): where ``pattern`` matches in ``text``, leftmost and without overlap.

    Texts between matches come from split(), the matches from regexp_extract_all(); their lengths add up
    to positions in code points. ``least``: group and its least length, else the match is dropped.
    """
    p = _quoted(pattern)
    group = f"regexp_extract_all({text}, {p}, {least[0]})" if least else f"regexp_extract_all({text}, {p}, 0)"
    # x: the text before a match, the match, its group; the last one is the text after all matches
    parts = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), {group})"
    lengths = "transform(x, w -> char_length(w.`0`) + coalesce(char_length(w.`1`), 0))"
    placed = f"zip_with(x, {_scan(lengths)}, (w, at) -> named_struct('s', at + char_length(w.`0`), 'e', at + char_length(w.`0`) + char_length(w.`1`), 'v', w.`2`))"
    kept = f"filter({placed}, y -> char_length(y.v) >= {least[1] if least else 1})"
    return f"if({text} rlike {p}, {_bound(parts, 'x', kept)}, cast(array() as array<struct<s:int,e:int,v:string>>))"


def _windows(candidate: str) -> str:
    """SQL for the joined spans, relative to the candidate's start, of windows with enough entropy."""
    w = WINDOW
    table = "array(" + ", ".join(f"{k * math.log2(k) if k else 0.0}D" for k in range(w + 2)) + ")"
    term = lambda count: f"element_at({table}, {count} + 1)"  # noqa: E731  count * log2(count)
    count = lambda start, length, place: f"size(filter(slice(c, {start}, {length}), v -> v = c[{place}]))"
    # the first window of a chunk is summed up; each next one, at i, lacks character i - 1 and has character i + w - 1 more
    first = f"aggregate(sequence(0, {w - 1}), 0D, (t, j) -> t + log2({count('b + 1', w, 'b + j')}))"
    moved = (
        f"a.t + {term(count('i + 1', w, f'i + {w} - 1'))} - {term(count('i + 1', w - 1, f'i + {w} - 1'))} + {term(count('i + 1', w - 1, 'i - 1'))} "
        f"- {term(count('i', w, 'i - 1'))}"
    )
    full = f"{math.log2(w)}D - x.t / {w} >= {{limit}}"
    step = f"transform(array(if(i = b, a.t, {moved})), t -> named_struct('t', t, 'out', array_append(a.out, named_struct('i', i, 't', t))))[0]"
    chunk = (
        f"aggregate(sequence(b, least(b + {CHUNK - 1}, size(c) - {w})), named_struct('t', {first}, 'out', cast(array() as array<struct<i:int,t:double>>)), "
        f"(a, i) -> {step}).out"
    )
    every = f"flatten(transform(sequence(0, size(c) - {w}, {CHUNK}), b -> {chunk}))"
    limit = (
        f"case when {candidate} rlike '^[0-9a-f]+$' or {candidate} rlike '^[0-9A-F]+$' then {LIMITS['hex']}D when {candidate} rlike "
        f"'^[0-9a-z]+$' then {LIMITS['base36']}D else {LIMITS['base64']}D end"
    )
    at = f"transform(filter({every}, x -> {full.format(limit='k.limit')}), x -> x.i)"
    clear = "if(size(k.bad) = 0, f, filter(f, i -> not exists(k.bad, y -> y.s < i + {w} and i < y.e)))".replace("{w}", str(w))
    # windows that touch are one span: it starts where there is none close before, and ends where there is none close after
    begin = f"filter(g, (i, n) -> n = 0 or i - g[n - 1] > {w})"
    end = f"filter(g, (i, n) -> n = size(g) - 1 or g[n + 1] - i > {w})"
    spans = f"zip_with({begin}, {end}, (x, y) -> named_struct('s', x, 'e', y + {w}))"
    known = f"named_struct('limit', {limit}, 'bad', {_spans(candidate, HARMLESS)})"
    inside = _bound(known, "k", _bound(f"split({candidate}, '')", "c", _bound(at, "f", _bound(clear, "g", spans))))
    return inside


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(element_at(array({', '.join(map(repr, KINDS))}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def _scanned(texts: DataFrame) -> DataFrame:
    """(carry, text) rows with the arrays base, entropy and found of (s, k, e) by start and kind."""
    tagged = lambda spans, k: f"transform({spans}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))"
    found = texts.select(
        "carry", "text",
        F.expr(tagged(_spans("text", ASSIGN, (2, 6)), 0)).alias("assign"),
        F.expr(tagged(_spans("text", ACCESS), 1)).alias("access"),
        F.expr(tagged(_spans("text", HEX), 2)).alias("hex"),
        F.expr(f"filter({_spans('text', CANDIDATE)}, x -> not ({' or '.join(f'x.v rlike {_quoted(p)}' for p in ALLOWED)}))").alias("candidates"),
    )
    based = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    added = based.withColumn("raised", F.expr(f"flatten(transform(candidates, x -> transform({_windows('x.v')}, w -> named_struct('s', x.s + w.s, 'k', 3, 'e', x.s + w.e))))"))
    own = added.withColumn("entropy", F.expr("filter(raised, x -> not exists(base, b -> b.s <= x.s and x.e <= b.e))"))
    return own.withColumn("found", F.array_sort(F.concat("base", "entropy")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, found (array of s, k, e by start and kind)."""
    every = _scanned(documents(docs).select(F.col("doc_id").alias("carry"), F.coalesce("text", F.lit("")).alias("text")))
    return every.select(
        F.col("carry").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("found")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
        "found",
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span masked in ``text``; ``n_chars``, if there, follows. No row goes, no other column changes."""
    every = _scanned(docs.select(F.struct("*").alias("carry"), F.coalesce("text", F.lit("")).alias("text")))
    clean = every.select("carry", F.when(F.size("found") > 0, redacted("text", "found", mask)).otherwise(F.col("carry.text")).alias("clean"), (F.size("found") > 0).alias("changed"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("changed"), F.char_length("clean").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("carry.n_chars") if "n_chars" in docs.columns else None)}
    return clean.select(*(new[c].alias(c) if c in new else F.col("carry").getField(c).alias(c) for c in docs.columns))


def _masked(text: str, found: str, mask: str) -> str:
    """SQL for ``text`` with each span of ``found``, at least one, replaced: what lies between the spans is cut from its characters."""
    before = _scan(f"transform({found}, x_ -> x_.e)", "greatest({}, {})")
    # a span that begins before an earlier one's end belongs to that one
    heads = f"filter(zip_with({found}, {before}, (x, m) -> named_struct('s', x.s, 'm', m)), y -> y.s >= y.m)"
    pieces = f"transform({heads}, y -> concat(array_join(slice(c, y.m + 1, y.s - y.m), ''), {_quoted(mask)}))"
    rest = f"array_join(slice(c, array_max(transform({found}, x -> x.e)) + 1, size(c)), '')"
    return _bound(f"split({text}, '')", "c", f"concat(array_join({pieces}, ''), {rest})")


def redacted(text: str = "text", found: str = "found", mask: str = "[SECRET]") -> Column:
    """The text column with each span of ``found`` (sorted; overlaps count once) replaced by ``mask``."""
    return F.expr(f"if(size({found}) > 0, {_masked(text, found, mask)}, {text})")
