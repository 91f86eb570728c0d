r"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From every rule's regular expression a Boolean query over trigrams is derived: what each match must contain. Postings of
the queries' trigrams, as rows (trigram, row key), are built from the texts in one scan; intersecting them per key gives
the rules for which a text is a candidate, and the expressions run over candidates only. A rule from which no trigram
follows (a run of hex digits) is run over every text. Trigrams are compared in lower case, so the index can only offer too
many candidates, never too few.

Keys are hashes of whole rows' ids and texts; two rows with one key would only be scanned for each other's rules too.
Candidates are few numbers a row: they are broadcast if there are at most BROADCAST_CANDIDATES, and joined by key if more.

Matches are found by marking: the expression's replacement puts a sentinel before and after each match, and running sums of
the lengths of what lies between sentinels give offsets in code points. Running sums and maxima are taken by doubled strides, so
a text of m matches costs m log m steps. Where a text holds a sentinel character itself, it is first replaced by another
character of the same length that no rule matches.

Defined results: null text counts as empty and has no spans. Spans of one kind do not overlap, spans of different kinds
may. Very long texts are scanned whole. Repeated rows are scanned one by one. Empty tables give no rows. Columns of any other
name take no part in a scan, and redaction leaves them alone.
A scan's span of a private key is its BEGIN line; redaction goes on through the key's body to its END line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from re import _parser as parser  # the public tree of the standard library's expressions

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import settled

MARK, SPLIT, PLAIN = "\ue000", "\ue001", "\ufffd"
BROADCAST_CANDIDATES = 500_000
REDACTED = "[secret]"
#: Characters in a block of a text that is rebuilt.
BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose `group` (0: all of it) has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds in their order, then the kinds that the method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)

#: White space, written out as well, as in quoted texts; the rest of a line that holds nothing more.
BLANK, ENDED = r"(?:\s|\\[nr])*+", r"(?=[^\S\r\n]*+(?![^\r\n]))"
#: What follows a key's BEGIN line: all up to its END line; where that is missing, header lines, then base64 in long runs or alone on a line.
BODY = (
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{BLANK}(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:{BLANK}[A-Za-z0-9+/]{{40,}}+={{0,2}}+|[^\S\r\n]*+[\r\n]\s*+[A-Za-z0-9+/]++={{0,2}}+{ENDED})*+)"
)
#: The rules of redaction: a private key goes as a whole, where a scan says where it begins.
WHOLE = tuple(replace(r, regex=r.regex + BODY) if r.kind == "pem" else r for r in RULES)

#: A query: a conjunction of disjunctions of conjunctions of trigrams.
Query = list[list[frozenset[str]]]
#: Strings that a stretch of an expression is spelled out into at most.
SPELLED = 64


def trigram_query(regex: str) -> Query:
    """What every match contains. Empty: nothing is known to be in all of them."""
    out: Query = []
    _close(out, _spell(parser.parse(regex), {""}, out))
    return out


def _close(out: Query, strings: set[str]) -> None:
    found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if all(found):
        out.append([x for x in found if not any(y < x for y in found)])


def _spell(items, strings: set[str], out: Query) -> set[str]:
    """Goes on spelling out what `strings` begin; closes a stretch wherever that is not possible."""
    for op, arg in items:
        name, more = str(op), None
        if name == "LITERAL":
            more = {chr(arg).lower()}
        elif name == "IN":
            more = _class(arg)
        elif name == "SUBPATTERN":
            strings = _spell(arg[3], strings, out)
            continue
        elif name == "BRANCH":
            inner: list[Query] = [[] for _ in arg[1]]
            sets = [_spell(x, set(strings), q) for x, q in zip(arg[1], inner, strict=True)]
            if not any(inner) and sum(map(len, sets)) <= SPELLED:
                strings = set().union(*sets)
                continue
            # an alternative that went on after a gap: each alternative's first disjunction stands for it
            for q, s in zip(inner, sets, strict=True):
                _close(q, s)
            if all(inner):
                out.append([x for q in inner for x in q[0]])
            strings = {""}
            continue
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            once = _spell(body, {""}, scrap := [])
            if not scrap and high <= 1 and len(once) <= SPELLED and low == 0:
                more = {"", *once}
            elif low > 0:
                for _ in range(min(low, 3)):
                    strings = _spell(body, strings, out)
                if high != low or low > 3:
                    _close(out, strings)
                    strings = {""}
                continue
        if more and len(strings) * len(more) <= SPELLED:
            strings = {a + b for a in strings for b in more}
        else:
            _close(out, strings)
            strings = {""}
    return strings


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < SPELLED:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _text(column: str) -> Column:
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(SPLIT)), F.translate(text, MARK + SPLIT, PLAIN * 2)).otherwise(text)


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """key, trigram (its number): the inverted index's rows for these trigrams. keyed: key, low (text in lower case)."""
    return keyed.select("key", F.explode(F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))).alias("trigram"))


def candidates(keyed: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key, and a column for each rule: whether the intersected postings satisfy its query."""
    trigrams = sorted({t for q in queries.values() for either in q for every in either for t in every})
    number = {t: i for i, t in enumerate(trigrams)}
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, F.expr("shiftleft(1L, trigram % 60)")).otherwise(F.lit(0).cast("long"))).alias(f"has{w}")
    words = range(1 + len(trigrams) // 60)
    sets = postings(keyed, trigrams).groupBy("key").agg(*map(bit, words))

    def every(need: frozenset[str]) -> Column:
        masks = [sum(1 << (number[t] % 60) for t in need if number[t] // 60 == w) for w in words]
        tests = [F.col(f"has{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in zip(words, masks, strict=True) if m]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    flags = []
    for kind, q in queries.items():
        flag = F.lit(True)
        for either in q:
            some = F.lit(False)
            for need in either:
                some = some | every(need)
            flag = flag & some
        flags.append(flag.alias(kind))
    some = F.lit(False)
    for kind in queries:
        some = some | F.col(kind)
    return sets.select("key", *flags).where(some)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once: inside lambdas it would be again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, join over it and all before it."""

    def double(now: Column, k: Column) -> Column:
        stride = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(now, lambda x, i: F.when(i >= stride, join(x, F.get(now, i - stride))).otherwise(x))

    steps = F.call_function("bin", F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(F.sequence(F.lit(0), F.length(steps) - 1), values, double)


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Spans of one rule, as structs (start, kind, end)."""
    marked = F.split(F.regexp_replace(text, F.lit(f"{rule.regex}"), F.lit(f"{MARK}$0{SPLIT}${rule.group}{MARK}")), MARK)
    # every second part is a match
    inside = lambda i: i % 2 == 1
    sizes = lambda parts: F.transform(parts, lambda x, i: F.when(inside(i), F.length(F.substring_index(x, SPLIT, 1))).otherwise(F.length(x)))
    span = lambda parts, n, ends: F.transform(
        parts, lambda x, i: F.when(inside(i) & (F.length(F.substring_index(x, SPLIT, -1)) >= rule.least), F.struct((F.get(ends, i) - F.get(n, i)).alias("start"), F.lit(number).alias("kind"), F.get(ends, i).alias("end")))
    )
    each = _with(marked, lambda parts: _with(sizes(parts), lambda n: _with(_running(n, lambda a, b: a + b), lambda ends: span(parts, n, ends))))
    return F.filter(each, lambda s: s.isNotNull())


def _quick(rule: Rule) -> str:
    """An expression that finds something wherever the rule has a match that is long enough. Only a run of one class alone can be asked for by its length."""
    items = list(parser.parse(rule.regex))
    run = len(items) == 1 and str(items[0][0]) == "MAX_REPEAT" and items[0][1][0] == 1 and [str(x[0]) for x in items[0][1][2]] in (["IN"], ["LITERAL"])
    return re.sub(r"\+$", f"{{{rule.least},}}", rule.regex) if run and rule.least and not rule.group else rule.regex


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST_CANDIDATES) -> DataFrame:
    """doc (docs' columns), text, spans (sorted structs start, kind, end): a row for each row of docs."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    key = F.xxhash64(id_col, text_col)
    found = settled(candidates(docs.select(key.alias("key"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low")), queries), "secret-candidates")
    if found.count() <= broadcast:
        found = F.broadcast(found)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), key.alias("key"), _text(text_col).alias("text")).join(found, "key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for number, r in enumerate(rules):
        wanted = F.coalesce(F.col(r.kind), F.lit(False)) if r.kind in queries else F.col("text").rlike(_quick(r))
        each.append(F.when(wanted, _spans(F.col("text"), number, r)).otherwise(none))
    return rows.select("doc", "text", F.array_sort(F.concat(*each)).alias("spans"))


def _said(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST_CANDIDATES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each row of docs."""
    rows = with_spans(docs, rules, id_col, text_col, broadcast).select(F.col(f"doc.{id_col}").alias("doc_id"), "spans")
    base = F.filter(F.col("spans"), lambda s: F.element_at(F.array(*(F.lit(r.base) for r in rules)), s["kind"] + 1))
    of_kind = lambda k: F.filter(F.col("spans"), lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    return rows.select("doc_id", *counts, F.sha2(_said(base, rules), 256).alias("base_sha256"), _said(F.col("spans"), rules).alias("spans"))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in blocks of BLOCK. A substring of the text itself would be searched for from its beginning."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    piece = lambda x, i: F.substring(x, F.when(i == 0, start - first * BLOCK).otherwise(F.lit(0)) + 1, F.when(i == last - first, end - last * BLOCK).otherwise(F.lit(BLOCK)) - F.when(i == 0, start - first * BLOCK).otherwise(F.lit(0)))
    return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.transform(F.slice(blocks, first + 1, last - first + 1), piece), ""))


def _redacted(text: Column, spans: Column) -> Column:
    """text with REDACTED for each stretch of overlapping spans. A span that begins where those before end is a stretch of its own."""
    blocks = F.regexp_extract_all(text, F.lit(f"[\\s\\S]{{1,{BLOCK}}}"), F.lit(0))

    def rebuilt(b: Column, s: Column, ends: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        gaps = F.transform(s, lambda x, i: F.when(x["start"] >= before(i), F.concat(_cut(b, before(i), x["start"]), F.lit(REDACTED))).otherwise(F.lit("")))
        return F.concat(F.array_join(gaps, ""), _cut(b, F.array_max(ends), F.length(text)))

    return _with(blocks, lambda b: _with(spans, lambda s: _with(_running(F.transform(s, lambda x: x["end"]), F.greatest), lambda ends: rebuilt(b, s, ends))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = WHOLE, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", broadcast: int = BROADCAST_CANDIDATES) -> DataFrame:
    """docs with each stretch of secrets replaced by REDACTED (overlapping ones by one), and its length where docs have that column."""
    rows = with_spans(docs, rules, id_col, text_col, broadcast)
    text = F.col(f"doc.`{text_col}`")
    clean = F.when(F.size("spans") == 0, text).otherwise(_redacted(text, F.col("spans")))
    rows = rows.select("doc", clean.alias("clean"))
    change = {text_col: F.col("clean")} | ({length_col: F.length("clean").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return rows.select(*(change.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
