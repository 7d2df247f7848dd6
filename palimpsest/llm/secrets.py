"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that every match must contain
(lower case). Postings (trigram, doc) hold the trigrams that the rules ask for; the queries intersect
and unite them, and candidates are verified by the expression itself. A rule without a mandatory
trigram scans every text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cannot_contain, cut, fresh, may_contain, text_of


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have at least, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules and those that the method adds, as fixed values. All hold for Python's and Java's syntax alike.
BASE = (
    Rule("assign", r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a run's first start decides, so the least length can stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
#: Exact strings are kept apart while there are at most EXACT of them.
EXACT = 64
#: Candidates up to this number are broadcast (24 bytes each, so 24 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

ALL = None  #: the query that every text meets


def _and(a, b):
    if a is ALL or a == b:
        return b
    return a if b is ALL else ("and", a, b)


def _or(a, b):
    return ALL if a is ALL or b is ALL else a if a == b else ("or", a, b)


def _of(strings: set[str]):
    """The query for a text that contains one of the strings."""
    out = ()
    for s in sorted(strings):
        q = ALL
        for i in range(len(s) - 2):
            q = _and(q, s[i : i + 3])
        out = q if out == () else _or(out, q)
        if out is ALL:
            return ALL
    return ALL if out == () else out


def _chars(items) -> set[str] | None:
    """The lower-case characters of a class, None for many."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out.update(chr(x).lower() for x in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _part(op, arg):
    """(all strings that one item matches, or None if they are many; what a match needs besides)."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is C.IN:
        return _chars(arg), ALL
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        branches = [_walk(x) for x in arg[1]]
        if all(strings is not None for strings, _ in branches):
            return set().union(*(strings for strings, _ in branches)), ALL
        query = ()
        for strings, own in branches:
            own = own if strings is None else _of(strings)
            query = own if query == () else _or(query, own)
        return None, query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        strings, own = _walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if not low:
            return None, ALL
        return None, own if strings is None else _of(strings)
    return ({""}, ALL) if op in (C.AT, C.ASSERT, C.ASSERT_NOT) else (None, ALL)


def _walk(tree):
    """(all strings that the expression matches, or None; the query that any match meets)."""
    run, query, whole = {""}, ALL, True
    for op, arg in tree:
        strings, own = _part(op, arg)
        query = _and(query, own)
        if strings is not None and len(run) * len(strings) <= EXACT:
            run = {a + b for a, b in itertools.product(run, strings)}
        else:
            query, whole = _and(query, _of(run)), False
            run = strings if strings is not None and len(strings) <= EXACT else {""}
    return (run, ALL) if whole else (None, _and(query, _of(run)))


def trigram_query(pattern: str):
    """What every match of ``pattern`` contains, in lower case: a trigram, ("and" | "or", query, query) or ALL."""
    strings, query = _walk(parser.parse(pattern))
    return query if strings is None else _of(strings)


def trigrams(query) -> set[str]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, str) else trigrams(query[1]) | trigrams(query[2])


def build_index(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (gram: place in ``vocabulary``, doc) of the trigrams in each lower-case text, sorted within each segment."""
    lower = docs.select(F.col(id_col).alias("doc"), F.lower(text_of(text_col)).alias("lower"))
    found = F.array_distinct(F.regexp_extract_all("lower", F.lit(_anywhere(vocabulary)), F.lit(1)))
    place = F.create_map(*[F.lit(x) for i, t in enumerate(vocabulary) for x in (t, i)])
    grams = lower.select("doc", F.explode(found).alias("gram"))
    return grams.select(F.element_at(place, F.col("gram")).alias("gram"), "doc").sortWithinPartitions("gram", "doc")


def _anywhere(vocabulary: list[str]) -> str:
    """An expression that finds every trigram of the vocabulary in one pass, overlapping ones too, branching once per letter."""
    quote = lambda c: "\\" + c if not (c.isalnum() or ord(c) > 127) else c
    tree: dict[str, dict[str, str]] = {}
    for a, b, c in vocabulary:
        tree.setdefault(a, {}).setdefault(b, "")
        tree[a][b] += c
    second = lambda t: "|".join(quote(b) + "[" + "".join(map(quote, cs)) + "]" for b, cs in t.items())
    return "(?=(" + "|".join(f"{quote(a)}(?:{second(t)})" for a, t in tree.items()) + "))"


def candidates(index: DataFrame, vocabulary: list[str], queries: list) -> DataFrame:
    """(doc, rules): bit r of ``rules`` says that the doc's postings meet query r; docs that meet none are left out."""
    words = -(-max(1, len(vocabulary)) // 63)
    bit = F.expr("shiftleft(1L, cast(gram % 63 as int))")
    sums = [F.bit_or(F.when((F.col("gram") / 63).cast("int") == w, bit)).alias(f"w{w}") for w in range(words)]
    masks = index.groupBy("doc").agg(*sums)

    def meets(query) -> Column:
        if isinstance(query, str):
            i = vocabulary.index(query)
            return F.coalesce(F.col(f"w{i // 63}"), F.lit(0)).bitwiseAND(F.lit(1 << (i % 63))) != 0
        return (meets(query[1]) & meets(query[2])) if query[0] == "and" else (meets(query[1]) | meets(query[2]))

    rules = F.lit(0).cast("long")
    for r, query in enumerate(queries):
        if query is not ALL:
            rules = rules.bitwiseOR(F.when(meets(query), F.lit(1 << r)).otherwise(F.lit(0)))
    return masks.select("doc", rules.alias("rules")).where("rules <> 0")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(a: Column) -> Column:
    """For each i, the sum of the elements before the i-th, in n to the power 1.5 steps."""
    add = lambda x, y: x + y
    zero = F.lit(0).cast("long")

    def blocks(b: Column) -> Column:
        last = F.floor((F.size(a) - 1) / b).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(a, k * b + 1, b), zero, add))
        return let(sums, lambda s: F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(s, F.lit(1), k), zero, add)))

    def rest(b: Column, before: Column, i: Column) -> Column:
        k = F.floor(i / b).cast("int")
        return F.get(before, k) + F.aggregate(F.slice(a, k * b + 1, i - k * b), zero, add)

    each = F.sequence(F.lit(0), F.size(a) - 1)
    return let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda b: let(blocks(b), lambda s: F.transform(each, lambda i: rest(b, s, i))))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans: array of (begin, order, stop), leftmost and not overlapping, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long"))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x).cast("long"))
    value = value if rule.group else found
    none = F.expr("cast(array() as array<struct<begin: bigint, order: int, stop: bigint>>)")

    def place(s: Column) -> Column:
        both = F.transform(s["found"], lambda m, i: m + F.get(s["gaps"], i))

        def at(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                begin = F.get(before, i) + F.get(s["gaps"], i)
                return F.struct(begin.alias("begin"), F.lit(order).alias("order"), (begin + m).alias("stop"))

            return F.filter(F.transform(s["found"], one), lambda x, i: F.get(s["value"], i) >= rule.least)

        return let(both, lambda a: let(_sums_before(a), at))

    all_ = let(F.struct(gaps.alias("gaps"), found.alias("found"), value.alias("value")), place)
    return F.when(F.rlike(text, pattern), all_).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, ``spans``: array of (begin, order, stop), sorted; ``order`` is the rule's place.

    Every row is scanned whole; a null text is empty and has no spans. Rows that share an id, or have none,
    are candidates together and verified each by its own text. No rows give no rows.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    queries = [trigram_query(r.pattern) for r in rules]
    vocabulary = sorted(set().union(*map(trigrams, queries)))
    doc, mask, out = fresh(docs, "scan_doc"), fresh(docs, "scan_rules"), fresh(docs, "spans")
    rows, met = docs, F.lit(0).cast("long")
    if vocabulary:
        index = cut(build_index(docs, vocabulary, id_col, text_col), "postings")
        found = cut(candidates(index, vocabulary, queries).toDF(doc, mask), "candidates")
        if found.count() <= BROADCAST_ROWS:
            rows = docs.join(F.broadcast(found), docs[id_col].eqNullSafe(F.col(doc)), "left")
        else:  # only texts that may be candidates move
            may, never = may_contain(docs, id_col, found, doc), cannot_contain(docs, id_col, found, doc)
            rows = may.join(found, may[id_col].eqNullSafe(F.col(doc)), "left")
            rows = rows.unionByName(never.withColumn(doc, F.lit(None).cast(found.schema[doc].dataType)).withColumn(mask, F.lit(None).cast("long")))
        met = F.coalesce(F.col(mask), met)
    each = []
    for r, rule in enumerate(rules):
        own = spans(text_of(text_col), rule, r)
        if queries[r] is not ALL:
            own = F.when(met.bitwiseAND(F.lit(1 << r)) != 0, own).otherwise(F.expr("cast(array() as array<struct<begin: bigint, order: int, stop: bigint>>)"))
        each.append(own)
    return rows.withColumn(out, F.array_sort(F.concat(*each))).drop(doc, mask)


def written(spans_: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as text: kind:begin:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat(F.get(kinds, s["order"]), F.lit(":"), s["begin"].cast("string"), F.lit(":"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans_, one), ",")
