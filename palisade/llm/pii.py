"""Personal data: fixed patterns and a linear-chain conditional random field (operator 10).

Contract.  ``find(docs)`` returns for every row ``doc_id``, ``n_email``, ``n_ip``, ``n_card``,
``n_phone`` (base spans), ``base_sha256`` and ``spans``: all spans as ``kind:start:end`` in code
points, end exclusive, by start and then kind, comma-joined.  ``find_spans`` returns them as arrays.

Base spans come from the patterns in :func:`base_spans`, in time linear in the text.  The random
field adds spans where shapes and their neighbours say so (e-mail, address, card, phone, secret); a
span that touches a base span is dropped, base spans stay.

Method.  Tokens are runs without blanks; chains end at line ends and after ``. ! ?``.  Features are
the token's shape (whole, and with runs collapsed), its size and kinds of characters, its word, and
the shapes of both neighbours.  :func:`train` fits weights and transitions to a small labelled table
by the exact gradient (forward-backward).  Decoding is Viterbi over all chains of a batch at once;
chains whose best possible gain over "nothing found" is not positive are settled beforehand by an
upper bound, which changes no result.

Edge cases: null and empty texts have no spans and the sha256 of the empty string; very long texts
are read whole; repeated rows are all returned; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import CHUNK, LOWER, hash_spans, mix, runs, text_buffer, chunks

#: Kinds in the order of the contract; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

# ---------------------------------------------------------------- base spans

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(t: str):
    last, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > last and t[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
        # the local part may not reach back over this sign, nor over the match
        last = m.end() if m else at + 1
        at = t.find("@", last)


def _to_255(digits: str) -> bool:
    """Whether a run of digits, of any length, is a number of at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _ips(t: str):
    group: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(t):
        s, e = m.span()
        if group and (s != group[-1][1] + 1 or t[s - 1] != "."):
            group = []
        group.append((s, e))
        if len(group) == 4:
            if all(_to_255(t[s:e]) for s, e in group):
                yield group[0][0], e
            group = []


def _cards(t: str):
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            yield m.span()


def _phones(t: str):
    for m in _PHONE.finditer(t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(t)] if "@" in t else []
    if _DIGITS.search(t):
        out += [(s, 1, e) for s, e in _ips(t)] + [(s, 2, e) for s, e in _cards(t)]
        out += [(s, 3, e) for s, e in _phones(t)] if "+" in t else []
    return sorted(out)


# ---------------------------------------------------------------- labelled table


def labelled_table(seed: int = 11, rounds: int = 14) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small table of (text, [(start, end, kind)]), the same for equal arguments."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[int(r.integers(len(x)))]
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    hexa = lambda n: "".join("0123456789abcdef"[i] for i in r.integers(0, 16, n))
    word = lambda: "".join(pick("an", "er", "ou", "tion", "the", "lich", "ment", "ci", "que", "re", "st") for _ in range(int(r.integers(1, 5))))
    key = lambda: "".join("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"[i] for i in r.integers(0, 57, int(r.integers(20, 44))))
    value = {
        "email": lambda: pick(f"{word()}@{word()}.com", f"{word()}.{word()}@mail{num(1)}.example.com", f"{word()}{num(2)}@{word()}.org", f"{word()} [at] {word()} [dot] com"),
        "ip": lambda: ".".join(str(x) for x in r.integers(1, 255, 4)) + pick("", "", ":8080"),
        "card": lambda: pick(num(16), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"),
        "phone": lambda: pick(f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}"),
        "secret": lambda: pick(f'"{hexa(40)}"', hexa(32), f"'{key()}'", "sk-" + key(), "AKIA" + key()[:16].upper()),
    }
    lead = {
        "email": ("mail", "write to", "e-mail:", ""), "ip": ("from", "host", "at", ""), "card": ("card", "card number", "", "paid with"),
        "phone": ("call", "phone:", "tel.", ""), "secret": ("token =", "api_key =", "password:", "secret ="),
    }
    plain = (lambda: num(int(r.integers(1, 5))), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.", lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"{num(2)}:{num(2)}", lambda: f"${num(1)},{num(3)}", lambda: word().upper() + "!!", lambda: word() + pick("***", "%%%", "&&&", "$$$", "###"), lambda: word().title() + ",", lambda: "|", lambda: f"http://{word()}.example.com/{word()}/{num(3)}", lambda: word() + "." + word(), lambda: word() + "-" + word(), lambda: "MIT", lambda: "BY-NC", lambda: f"({word()})", lambda: f"{num(3)}%")
    table = []
    for _ in range(rounds):
        for kind in KINDS:
            for first in lead[kind]:
                text = " ".join(word() for _ in range(int(r.integers(0, 4))))
                text = f"{text} {first}".strip()
                v = value[kind]()
                start = len(text) + bool(text)
                text = f"{text} {v}".strip()
                core = v.strip("\"'")
                s = start + v.find(core)
                spans = [(s, s + len(core), kind)]
                text += pick("", ".", ",", "") + pick("", " " + " ".join(word() for _ in range(int(r.integers(0, 4)))))
                table.append((text.rstrip(), spans))
        for f in plain:
            text = " ".join([*(word() for _ in range(int(r.integers(0, 4)))), f(), *(word() for _ in range(int(r.integers(0, 4))))])
            table.append((text, []))
            table.append((" ".join(word() if r.random() < 0.8 else f() for _ in range(int(r.integers(3, 9)))) + ".", []))
    return table


# ---------------------------------------------------------------- features

_CLASS = np.full(256, ord("x"), np.uint8)
_CLASS[:0x80] = np.arange(0x80)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = ord("X"), ord("x"), ord("d")
N_FEATURES = 7


@dataclass
class Tokens:
    """Runs without blanks of a text column, chains of them, and their features."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    chain: np.ndarray
    features: np.ndarray


def tokenise(column: pa.Array) -> Tokens:
    data, offsets = text_buffer(column)
    starts, ends = runs((data > 0x20) & (data != 0x7F), offsets)
    n = len(starts)
    if not n:
        return Tokens(data, offsets, starts, ends, np.zeros(1, np.int64), np.zeros((0, N_FEATURES), np.uint64))
    lines = np.cumsum(data == 0x0A)
    row = np.searchsorted(offsets, starts, "right")
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
    new = np.append(True, stop[:-1] | (row[1:] != row[:-1]) | (lines[starts[1:]] != lines[starts[:-1]]))
    shape = _CLASS[data]
    # runs of one class within a token count once
    first = np.append(True, shape[1:] != shape[:-1])
    first[starts] = True
    keep = first & (data > 0x20) & (data != 0x7F)
    place = np.append(0, np.cumsum(keep))
    brief = hash_spans(shape[keep], place[starts], place[ends])
    whole = hash_spans(shape, starts, ends)
    word = hash_spans(LOWER[data], starts, ends)
    digits = np.append(0, np.cumsum((data >= 0x30) & (data <= 0x39)))
    alpha = np.append(0, np.cumsum((shape == ord("x")) | (shape == ord("X"))))
    size, nd, na = ends - starts, digits[ends] - digits[starts], alpha[ends] - alpha[starts]
    hexa = np.append(0, np.cumsum(((LOWER[data] >= 0x61) & (LOWER[data] <= 0x66)) | ((data >= 0x30) & (data <= 0x39))))
    kind = np.minimum(size, 64) // 4 * 1000 + np.minimum(nd, 20) * 10 + (na == 0) * 2 + (hexa[ends] - hexa[starts] >= size - 2)
    before, after = np.append(np.uint64(1), brief[:-1]), np.append(brief[1:], np.uint64(2))
    before[new] = 1
    after[np.append(new[1:], True)] = 2
    salt = lambda x, i: mix(x.astype(np.uint64) + np.uint64(i * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    with np.errstate(over="ignore"):
        f = [salt(x, i + 1) for i, x in enumerate((brief, whole, word, kind, before, after, np.where(nd > 0, brief ^ after, brief ^ before)))]
    return Tokens(data, offsets, starts, ends, np.append(np.flatnonzero(new), n), np.stack(f, 1))


# ---------------------------------------------------------------- the random field


@dataclass
class Field:
    """Sorted feature hashes, their weights (row 0 is for unknown ones), and transitions."""

    known: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    map: np.ndarray

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(f), len(LABELS)), np.float32)
        for j in range(f.shape[1]):
            at = np.flatnonzero(self.map[f[:, j] >> np.uint64(48)])
            slot = np.minimum(np.searchsorted(self.known, f[at, j]), len(self.known) - 1)
            same = self.known[slot] == f[at, j]
            out[at[same]] += self.weights[slot[same]]
        return out


def _targets(table) -> tuple[Tokens, np.ndarray]:
    tokens = tokenise(pa.array([t for t, _ in table], pa.large_string()))
    y = np.zeros(len(tokens.starts), np.int64)
    row = np.searchsorted(tokens.offsets, tokens.starts, "right") - 1
    for i, (text, spans) in enumerate(table):
        own = np.flatnonzero(row == i)
        for s, e, kind in spans:
            s, e = (len(text[:x].encode()) + tokens.offsets[i] for x in (s, e))
            hit = own[(tokens.starts[own] < e) & (tokens.ends[own] > s)]
            y[hit] = LABELS.index(f"I-{kind}")
            y[hit[:1]] = LABELS.index(f"B-{kind}")
    return tokens, y


def train(table=None, steps: int = 160, rate: float = 0.08, ridge: float = 2e-3) -> Field:
    """Maximum likelihood by Adam; chains are padded to one length."""
    tokens, y = _targets(labelled_table() if table is None else table)
    known, slot = np.unique(tokens.features, return_inverse=True)
    slot = slot.reshape(tokens.features.shape)
    lo = tokens.chain
    size = np.diff(lo)
    order = np.argsort(-size, kind="stable")
    lo, size = lo[:-1][order], size[order]
    n, k, m = len(size), len(LABELS), len(known)
    w, move, begin = np.zeros((m, k)), np.zeros((k, k)), np.zeros(k)
    active = [int((size > t).sum()) for t in range(size.max())]
    last = lo + size - 1
    prev = np.flatnonzero(~np.isin(np.arange(len(y)), lo))
    gold_move = np.zeros((k, k))
    np.add.at(gold_move, (y[prev - 1], y[prev]), 1)
    gold_begin = np.bincount(y[lo], minlength=k).astype(float)
    params, ms, vs = [w, move, begin], [0, 0, 0], [0, 0, 0]

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = params[0][slot].sum(1)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[lo] = e[lo] + params[2]
        for t in range(1, len(active)):
            i = lo[: active[t]] + t
            a[i] = e[i] + lse(a[i - 1][:, :, None] + params[1], 1)
        for t in range(len(active) - 2, -1, -1):
            i = lo[: active[t + 1]] + t
            b[i] = lse(params[1] + (e[i + 1] + b[i + 1])[:, None, :], 2)
        z = np.empty(len(y))
        total = lse(a[last], 1)
        z[:] = np.repeat(total[np.argsort(order, kind="stable")], np.diff(tokens.chain))
        p = np.exp(a + b - z[:, None])
        pair = np.exp(a[prev - 1][:, :, None] + params[1] + (e[prev] + b[prev])[:, None, :] - z[prev][:, None, None]).sum(0)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        gw = np.zeros((m, k))
        for j in range(slot.shape[1]):
            np.add.at(gw, slot[:, j], d)
        grads = [gw / n + ridge * params[0], (pair - gold_move) / n + ridge * params[1], (p[lo].sum(0) - gold_begin) / n + ridge * params[2]]
        for j, g in enumerate(grads):
            ms[j] = 0.9 * ms[j] + 0.1 * g
            vs[j] = 0.99 * vs[j] + 0.01 * g * g
            params[j] = params[j] - rate * (ms[j] / (1 - 0.9**step)) / (np.sqrt(vs[j] / (1 - 0.99**step)) + 1e-8)
    # an inside label follows its own kind only
    move, begin = params[1].copy(), params[2].copy()
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            begin[j] = -1e4
            move[[i for i, x in enumerate(LABELS) if x[2:] != name[2:]], j] = -1e4
    seen = np.zeros(1 << 16, bool)
    seen[known >> np.uint64(48)] = True
    return Field(known, params[0].astype(np.float32), move.astype(np.float32), begin.astype(np.float32), seen)


def viterbi(field: Field, tokens: Tokens) -> np.ndarray:
    """The best label of every token."""
    y = np.zeros(len(tokens.starts), np.int64)
    if not len(y):
        return y
    e = field.emissions(tokens.features)
    lo, size = tokens.chain[:-1], np.diff(tokens.chain)
    gain = (e[:, 1:] - e[:, :1]).max(1) + max(float((field.move - field.move[0, 0]).max()), float((field.begin - field.begin[0]).max()))
    # moving back to "nothing found" may gain too
    back = max(0.0, float((field.move[:, 0] - field.move[0, 0]).max()))
    busy = np.add.reduceat((gain + back > 0).astype(np.int64), lo) > 0
    lo, size = lo[busy], size[busy]
    if not len(lo):
        return y
    order = np.argsort(-size, kind="stable")
    lo, size = lo[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")
    best = np.zeros((len(y), len(LABELS)), np.int8) if len(lo) else None
    s = e[lo] + field.begin
    final = s.copy()
    for t in range(1, size[0]):
        n = active[t]
        x = s[:n, :, None] + field.move
        i = lo[:n] + t
        best[i] = x.argmax(1)
        s = x.max(1) + e[i]
        final[:n] = s
    y[lo + size - 1] = label = final.argmax(1)
    for t in range(size[0] - 1, 0, -1):
        n = active[t]
        i = lo[:n] + t
        y[i - 1] = best[i, y[i]]
    del label
    return y


_STRIP = np.zeros(256, bool)
_STRIP[np.frombuffer(b"\"'<>[]{},;:.!?=`|%*&$#", np.uint8)] = True


def learned_spans(field: Field, tokens: Tokens) -> list[tuple[int, int, int, int]]:
    """(row, start, number of the kind, end) in code points of the row."""
    y = viterbi(field, tokens)
    hit = np.flatnonzero(y)
    if not len(hit):
        return []
    chars = np.append(0, np.cumsum((tokens.data & 0xC0) != 0x80))
    out, i = [], 0
    while i < len(hit):
        j, kind = i + 1, (y[hit[i]] - 1) // 2
        while j < len(hit) and hit[j] == hit[j - 1] + 1 and y[hit[j]] == 2 * kind + 2:
            j += 1
        s, e = int(tokens.starts[hit[i]]), int(tokens.ends[hit[j - 1]])
        while s < e and _STRIP[tokens.data[s]]:
            s += 1
        while e > s and (_STRIP[tokens.data[e - 1]] or tokens.data[e - 1] == 0x29):
            e -= 1
        if s < e:
            row = int(np.searchsorted(tokens.offsets, s, "right")) - 1
            base = chars[tokens.offsets[row]]
            out.append((row, int(chars[s] - base), int(kind), int(chars[e] - base)))
        i = j
    return out


_fields: dict[int, Field] = {}


def default_field() -> Field:
    """The field trained on the default table, once in a process."""
    if 0 not in _fields:
        _fields[0] = train()
    return _fields[0]


def _all(batches, field: Field):
    """Chunks with the base spans and all spans of their rows."""
    for b in chunks(batches):
        column = b.column(1)
        extra: dict[int, list] = {}
        for row, s, k, e in learned_spans(field, tokenise(column)):
            extra.setdefault(row, []).append((s, k, e))
        base = [base_spans(t) if t else [] for t in column.to_pylist()]
        both = []
        for i, own in enumerate(base):
            add = [x for x in extra.get(i, ()) if all(x[2] <= s or x[0] >= e for s, _, e in own)] if len(own) < 64 or i not in extra else _apart(extra[i], own)
            both.append(sorted(own + add) if add else own)
        yield b, base, both


def _apart(extra, own):
    """The spans of extra that touch none of own, for many of both."""
    s, e = np.array([x[0] for x in own]), np.maximum.accumulate(np.array([x[2] for x in own]))
    out = []
    for x in extra:
        i = int(np.searchsorted(s, x[2], "left")) - 1
        if i < 0 or e[i] <= x[0]:
            out.append(x)
    return out


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """See the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches):
        for b, base, both in _all(batches, shared.value):
            counts = [pa.array([sum(k == j for _, k, _ in x) for x in base], pa.int64()) for j in range(4)]
            sha = [hashlib.sha256(_join(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array([_join(x) for x in both], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def find_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans): arrays of kind, start, end and the text found."""
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        for b, _, both in _all(batches, shared.value):
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in x] for t, x in zip(b.column(1).to_pylist(), both)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")
