"""Secret scan through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match
must contain (the regexp-index construction of Russ Cox's code search). Documents are
indexed block by block: postings of the needed trigrams, as sorted document numbers. The
queries intersect and unite postings, and only the surviving candidates are verified with
the expression itself. A rule from which no trigram follows scans every document.

The index lives within a map task, so nothing is shuffled, a lost executor costs the blocks
it held, and a hot source or a group of copies weighs no more than other rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import LOWER, sub_blocks, text_bytes
from lodestone.llm.shared import with_fields

try:
    from re import _constants as sre_c
    from re import _parser as sre_p
except ImportError:  # Python < 3.11
    import sre_constants as sre_c
    import sre_parse as sre_p


@dataclass(frozen=True)
class Rule:
    """group: the group whose length counts; least: its least length in code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.A


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.A | re.I),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What follows a key's first line: all up to its last line, or if that is missing the header and base64 lines (line ends may be escaped or blanks).
_KEY_BODY = r"""(?:(?:(?!-----(?:BEGIN|END)\x20)[\s\S])*+-----END\x20\1PRIVATE\x20KEY\2-----|(?:(?:\s|\\[rn])*+(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\r\n]*+|[A-Za-z0-9+/=]{24,}+|[A-Za-z0-9+/=]++(?=[\x20\t]*(?:[\r\n]|\\[rn]|\Z))))*+)"""
#: Formats that issuers publish.
MORE_RULES = (
    Rule("pem", r"-----BEGIN\x20([A-Z0-9\x20]*)PRIVATE\x20KEY((?:\x20BLOCK)?)-----" + _KEY_BODY),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 0, re.A | re.I),
    Rule("url", r"(?<![a-z])[a-z][a-z0-9+.-]++://[^\s:/@]+:[^\s:/@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (any document), a frozenset of trigrams joined by "or" of alternatives:
# ("tri", t), ("and", q...), ("or", q...).
_MOST = 64  # strings followed exactly before a node falls back to its trigrams


def _both(op: str, *qs):
    if op == "and":
        qs = [q for q in qs if q is not True]
        return True if not qs else qs[0] if len(qs) == 1 else ("and", *qs)
    return True if any(q is True for q in qs) or not qs else qs[0] if len(qs) == 1 else ("or", *qs)


def _of_strings(strings: frozenset[str]):
    """Every string's trigrams, alternatives united; True if one is shorter than three bytes."""
    return _both("or", *(_both("and", *(("tri", s[i : i + 3]) for i in range(len(s) - 2))) if len(s) > 2 else True for s in sorted(strings)))


def _in_chars(items) -> frozenset[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre_c.LITERAL and arg < 128:
            out.add(chr(arg).lower())
        elif op is sre_c.RANGE and arg[1] < 128:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> tuple[frozenset[str] | None, object]:
    """(the exact set of strings that this part matches, or None; a query that any match satisfies)."""
    run, query = frozenset({""}), True
    for op, arg in tree:
        exact, q = None, True
        if op is sre_c.LITERAL:
            exact = frozenset({chr(arg).lower()}) if arg < 128 else None
        elif op is sre_c.IN:
            exact = _in_chars(arg)
        elif op is sre_c.AT:
            continue
        elif op is sre_c.SUBPATTERN:
            exact, q = _walk(arg[3])
        elif op is sre_c.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*(e for e, _ in parts))
            q = _both("or", *(_both("and", y, _of_strings(e) if e is not None else True) for e, y in parts))
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT, getattr(sre_c, "POSSESSIVE_REPEAT", None)):
            low, high, sub = arg
            e, y = _walk(sub)
            if e is not None and high != sre_c.MAXREPEAT and high <= 3 and sum(len(e) ** n for n in range(low, high + 1)) <= _MOST:
                exact, grown = set(), {""}
                for n in range(high + 1):
                    if n >= low:
                        exact |= grown
                    grown = {a + b for a in grown for b in e}
                exact = frozenset(exact)
            elif low:
                q = _both("and", y, _of_strings(e) if e is not None else True)
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        query = _both("and", query, _of_strings(run), q, _of_strings(exact) if exact is not None else True)
        run = frozenset({""})
        if exact is not None:
            run = exact
    if query is True:
        return run if run != frozenset({""}) or not tree else None, _of_strings(run)
    return None, _both("and", query, _of_strings(run))


@lru_cache(maxsize=256)
def trigram_query(pattern: str, flags: int = re.A):
    """A Boolean query over lower-case trigrams that every text with a match satisfies; True where none follows."""
    return _walk(sre_p.parse(pattern, flags & ~re.I))[1]


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1:]))


def postings(data: np.ndarray, offsets: np.ndarray, grams: list[str], table: np.ndarray) -> dict[str, np.ndarray]:
    """The inverted index of a block: for each wanted trigram the sorted documents that hold it.

    table: of 2**24 codes, the trigram's number plus one, or 0.
    """
    low = LOWER[data].astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    number = table[code]
    at = np.flatnonzero(number)
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[doc + 1]  # not across two documents
    pairs = np.unique(number[at[inside]].astype(np.int64) * len(offsets) + doc[inside])
    gram, doc = np.divmod(pairs, len(offsets))
    cut = np.searchsorted(gram, np.arange(1, len(grams) + 2))
    return {g: doc[cut[i] : cut[i + 1]] for i, g in enumerate(grams)}


def candidates(query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Documents of the block that satisfy the query."""
    if query is True:
        return np.arange(n)
    if query[0] == "tri":
        return index[query[1]]
    parts = [candidates(q, index, n) for q in query[1:]]
    if query[0] == "and":
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True)
        return out
    return np.unique(np.concatenate(parts))


_tables: dict[tuple[str, ...], np.ndarray] = {}


def _table(grams: tuple[str, ...]) -> np.ndarray:
    if grams not in _tables:
        t = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(grams):
            a, b, c = g.encode()
            t[a << 16 | b << 8 | c] = i + 1
        _tables[grams] = t
    return _tables[grams]


def _runs_of(data: np.ndarray, offsets: np.ndarray, chars: bytes, least: int) -> np.ndarray:
    """Documents with a run of at least `least` of these bytes: the full scan of a rule that is one class."""
    allowed = np.zeros(256, bool)
    allowed[list(chars)] = True
    ok = np.concatenate(([False], allowed[data], [False]))
    edge = np.flatnonzero(ok[1:] != ok[:-1])
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    # a run may cross documents: every one that it touches is a candidate
    a = np.searchsorted(offsets, starts, "right") - 1
    b = np.searchsorted(offsets, ends - 1, "right") - 1
    return np.unique(np.concatenate([a, b, *(np.arange(x, y) for x, y in zip(a, b, strict=True) if y - x > 1)]))


def _full_scan(rule: Rule, data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    if rule.group == 0 and rule.least and (m := re.fullmatch(r"\[([0-9a-f-]+)\]\+", rule.pattern)):
        chars = bytes(c for c in range(128) if re.fullmatch(f"[{m[1]}]", chr(c)))
        return _runs_of(data, offsets, chars, rule.least)
    return np.arange(n)


def spans_of(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough, in code points."""
    found = re.compile(rule.pattern, rule.flags).finditer(text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_block(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each document its (start, rule number, end), sorted."""
    n = len(offsets) - 1
    asked = [trigram_query(r.pattern, r.flags) for r in rules]
    grams = tuple(sorted(set().union(*map(trigrams_of, asked))))
    index = postings(data, offsets, list(grams), _table(grams)) if len(data) > 2 else {g: np.zeros(0, np.int64) for g in grams}
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    texts: dict[int, str] = {}
    for k, (rule, query) in enumerate(zip(rules, asked, strict=True)):
        docs = _full_scan(rule, data, offsets, n) if query is True else candidates(query, index, n)
        for d in docs.tolist():
            if d not in texts:
                texts[d] = data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
            out[d] += [(s, k, e) for s, e in spans_of(rule, texts[d])]
    for x in out:
        x.sort()
    return out


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with every span, overlapping ones merged, replaced by mark."""
    out, at, open_to = [], 0, -1
    for s, _, e in spans:
        if s < open_to:
            open_to = max(open_to, e)
            continue
        if open_to >= 0:
            at = open_to
        out += [text[at:s], mark]
        open_to = e
    return "".join(out) + text[max(open_to, 0) :]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str | None = None) -> DataFrame:
    """docs with `secret_spans` (kind, start, end by start, then rule order) and, with mark, `redacted`.

    Null and empty texts have no spans; a null text stays null when redacted. Texts are scanned
    whole whatever their length. Spans that begin together come in rule order; spans of different
    rules may overlap. Repeated rows get the same answer each, an empty table gives none. Columns
    of these two names in the input are replaced; all others stay.
    """
    added = ["secret_spans"] + (["redacted"] if mark is not None else [])
    keep = [c for c in docs.columns if c not in added]
    src = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = with_fields(src, "secret_spans array<struct<kind:string,start:bigint,end:bigint>>" + (", redacted string" if mark is not None else ""))
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            data, offsets = text_bytes(column)
            all_spans: list = []
            for _, _, d, o in sub_blocks(data, offsets):
                all_spans += scan_block(d, o, rules)
            arrays = [*batch.columns, pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in all_spans], span_type)]
            if mark is not None:
                arrays.append(pa.array([redact(column[i].as_py(), x, mark) if x else None for i, x in enumerate(all_spans)], pa.string()))
                arrays[-1] = pc.coalesce(arrays[-1], column.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added])

    return src.mapInArrow(run, schema)


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's row per document. Base kinds are those of BASE_RULES."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = {r.kind: i for i, r in enumerate(rules) if r in BASE_RULES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts: list[list[int]] = [[], [], []]
            sha, spans = [], []
            for _, _, d, o in sub_blocks(data, offsets):
                for x in scan_block(d, o, rules):
                    of_base = [y for y in x if rules[y[1]].kind in base]
                    for i, r in enumerate(BASE_RULES):
                        counts[i].append(sum(rules[k].kind == r.kind for _, k, _ in of_base))
                    sha.append(hashlib.sha256(_joined(of_base, rules).encode()).hexdigest())
                    spans.append(_joined(x, rules))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return src.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return secret_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
