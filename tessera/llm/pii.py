"""Personal data by a skip-chain conditional random field over each whole document.

Base matches (email, ip, card, phone) come from fixed patterns. Every word that holds a digit or ``@`` is a node with
one of five labels (none or a kind); base words are observed. Neighbouring nodes share a chain potential; words with
the same key anywhere in the document (same folded form, same last seven digits, same local part of an address) share
a skip potential, each occurrence with the next one, so a word that repeats n times costs n - 1 links. Loopy message
passing runs over all documents of a pass at once. Neighbouring free words of one sure label become a further span, if
it has as many digits as that kind asks for.

The potentials are trained piecewise in numpy: a maximum-entropy unary model of word shape on a bounded sample, and
label co-occurrence of linked words over all documents with a documented prior for agreement. The labels are the base
matches; so that the model does not merely repeat the patterns, each match also trains with the features hidden that
its pattern asks for, and words in doubt train nothing: those that a skip link ties to a match, and those of a phone
pattern that ran on over too many digits. On a part of the sample that trains nothing, every second match is hidden whole; the least
probability at which what is then found is precise enough is the one from which words count as sure.

Cases: a null text counts as empty and has no spans; very long texts are searched whole; repeated rows each get their
spans, and of several texts of one id the smallest one trains; spans of different kinds may overlap, further spans
never touch a base span; offsets are code points, end exclusive; extra columns are ignored; an empty table trains a
model that adds nothing and gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import sampled, training_ids
from .textarrays import SOLID, Texts, passes

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
# A word of digits starts where its run starts and a local part is the whole run before its @, so possessive runs
# match the same spans without rescanning long runs.
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = d - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind index, start, end) in bytes, by kind and start."""
    out = []
    at, done = raw.find(b"@"), 0
    while at >= 0:
        m = _DOMAIN.match(raw, at)
        if m:
            s = at
            while s > done and raw[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                done = m.end()
                out.append((0, s, done))
        at = raw.find(b"@", max(at + 1, done))
    for m in _IP.finditer(raw):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(raw):
        d = m[0].translate(None, b" -")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 8 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_SEP = re.compile(rb"[.,;:!?()\[\]\"']+$|^[\[\"'(]+")


def features(word: bytes, before: bytes, after: bytes) -> list[int]:
    """Indices of the shape features that hold for a word with its neighbours."""
    core = _SEP.sub(b"", word)
    d = core.translate(None, _NOT_DIGIT)
    letters = len(core.translate(None, b"0123456789.,;:()+@-_=/%")) > 0
    n = len(d)
    at = b"@" in core
    dots = core.count(b".")
    on = [
        True, at, at and b"." in core.partition(b"@")[2], n == 0, 1 <= n <= 3, 4 <= n <= 7, 8 <= n <= 15, 16 <= n <= 19, n > 19, letters,
        dots == 3 and not letters, dots == 3 and not letters and all(p.isdigit() and int(p) < 256 for p in core.split(b".") if len(p) < 5), core[:1] == b"+", word[:1] == b"(" or b")" in word,
        b"-" in core and not letters, before[-1:].isdigit() or before[-1:] == b")", after[:1].isdigit() or after[:1] == b"(", before[:1] == b"+", after[:1] == b"(", 16 <= n <= 19 and luhn(d), b"=" in word or b'"' in word, 16 <= n <= 19 and not luhn(d),
    ]
    return [k for k, v in enumerate(on) if v]


N_FEATURES = 22
#: Features that the base patterns ask for beyond a word's form: a domain, octets, a plus, a plus before, the check digit.
DECISIVE = (2, 11, 12, 17, 19)
#: Least and most digits of a further span of a kind, and whether it may span several words.
SHAPES = {"email": (0, 99, False), "ip": (4, 12, False), "card": (12, 19, True), "phone": (7, 15, True)}
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


def link_keys(word: bytes) -> list[bytes]:
    """Keys that make two words similar: folded form, last seven digits, local part."""
    core = _SEP.sub(b"", word).lower()
    d = core.translate(None, _NOT_DIGIT)
    keys = [core] if len(core) >= 4 else []
    if len(d) >= 7:
        keys.append(b"#" + d[-7:])
    if b"@" in core:
        local = core.partition(b"@")[0]
        if len(local) >= 4:
            keys.append(local)
    return keys


@dataclass
class Graph:
    """Nodes of a pass: text, byte span, features, observed label (-1: free) and links (from, to, is skip)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feats: list[list[int]]
    seen: np.ndarray
    links: np.ndarray
    base: list[list[tuple[int, int, int]]]
    doubt: np.ndarray | None = None  # free words that may be personal data for all the patterns know


def build(texts: Texts) -> Graph:
    buf, n = texts.buf, len(texts)
    digit = (buf >= 48) & (buf <= 57) | (buf == 64)
    total = np.concatenate(([0], np.cumsum(digit)))
    s, e, owner = texts.words(SOLID)
    hit = np.flatnonzero(total[e] > total[s]) if len(s) else np.zeros(0, np.int64)
    base: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    links, feats = [], []
    seen, doubt = np.full(len(hit), -1), np.zeros(len(hit), bool)
    cuts = np.searchsorted(owner[hit], np.arange(n + 1))
    for i in np.unique(owner[hit]).tolist() if len(hit) else []:
        lo = int(texts.offsets[i])
        raw = buf[lo : int(texts.offsets[i + 1])].tobytes()
        base[i] = base_spans(raw)
        k0, k1 = int(cuts[i]), int(cuts[i + 1])
        starts, ends = s[hit[k0:k1]] - lo, e[hit[k0:k1]] - lo
        for kind, a, b in reversed(base[i]):
            x, y = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))
            seen[k0 + x : k0 + y] = kind + 1
        for m in _PHONE.finditer(raw) if b"+" in raw else ():
            if len(m[0].translate(None, _NOT_DIGIT)) > 15:
                x, y = int(np.searchsorted(ends, m.start(), side="right")), int(np.searchsorted(starts, m.end(), side="left"))
                doubt[k0 + x : k0 + y] = True
        last: dict[bytes, int] = {}
        for k in range(k0, k1):
            w = int(hit[k])
            word = raw[s[w] - lo : e[w] - lo]
            before = raw[s[w - 1] - lo : e[w - 1] - lo] if w and owner[w - 1] == i else b""
            after = raw[s[w + 1] - lo : e[w + 1] - lo] if w + 1 < len(s) and owner[w + 1] == i else b""
            feats.append(features(word, before, after))
            if k > k0 and hit[k - 1] == w - 1:
                links.append((k - 1, k, 0))
            for key in link_keys(word):
                if last.get(key, k) != k:
                    links.append((last[key], k, 1))
                last[key] = k
    h, links = hit, np.array(sorted(set(links)), np.int64).reshape(-1, 3)
    a, b = links[links[:, 2] == 1, :2].T
    doubt[a[seen[b] > 0]] = doubt[b[seen[a] > 0]] = True
    return Graph(owner[h], s[h], e[h], feats, seen, links, base, doubt & (seen < 0))


@dataclass
class SkipChainModel:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray
    sure: float = 0.9
    precision: float = 1.0  # of words found on the part of the sample that sets ``sure``, and their share of all hidden
    recall: float = 0.0

    def marginals(self, g: Graph, rounds: int = 12, damp: float = 0.5, settled: float = 1e-4) -> np.ndarray:
        """Label probabilities of all nodes by loopy message passing; observed nodes are fixed.

        After every ``rounds`` rounds the documents whose messages changed less than ``settled`` are done; the others go
        on, where messages do not settle at all for twice the damped way over all links of the document.
        """
        n, L = len(g.doc), len(LABELS)
        u = np.zeros((n, L))
        if n:
            np.add.at(u, np.repeat(np.arange(n), [len(f) for f in g.feats]), self.unary[np.concatenate([np.array(f) for f in g.feats])])
        fixed = g.seen >= 0
        u[fixed] = -60.0
        u[fixed, g.seen[fixed]] = 0.0
        a, b, kind = g.links.T if len(g.links) else np.zeros((3, 0), np.int64)
        pot = np.exp(np.stack([self.chain, self.skip]))[kind]
        fwd, bwd = np.zeros((len(a), L)), np.zeros((len(a), L))
        on = np.arange(len(a))  # links of the documents that are not done
        count = np.bincount(g.doc[a], minlength=1)
        done = 0
        while len(on):
            x0, y0, p0 = a[on], b[on], pot[on]
            f, w = fwd[on], bwd[on]
            for _ in range(rounds):
                belief = u.copy()
                np.add.at(belief, y0, f)
                np.add.at(belief, x0, w)
                x, y = belief[x0] - w, belief[y0] - f
                x, y = np.exp(x - x.max(1, keepdims=True)), np.exp(y - y.max(1, keepdims=True))
                new_f = np.log(np.einsum("el,elm->em", x, p0) + 1e-30)
                new_b = np.log(np.einsum("em,elm->el", y, p0) + 1e-30)
                old_f, old_w = f, w
                f = damp * f + (1 - damp) * (new_f - new_f.max(1, keepdims=True))
                w = damp * w + (1 - damp) * (new_b - new_b.max(1, keepdims=True))
            fwd[on], bwd[on] = f, w
            done += rounds
            moved = np.maximum(np.abs(f - old_f).max(1), np.abs(w - old_w).max(1)) >= settled
            doc = g.doc[x0]
            open_ = np.bincount(doc, weights=moved, minlength=1) > 0
            on = on[open_[doc] & (2 * count[doc] / (1 - damp) + 10 * rounds > done)]
        belief = u
        np.add.at(belief, b, fwd)
        np.add.at(belief, a, bwd)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def hidden(g: Graph) -> tuple[Graph, np.ndarray]:
    """``g`` with every second base match hidden, its words without their decisive features; which words that are."""
    gone = np.zeros(len(g.seen), bool)
    new = np.concatenate(([True], (g.seen[1:] != g.seen[:-1]) | (g.doc[1:] != g.doc[:-1]))) if len(g.seen) else np.zeros(0, bool)
    match = np.cumsum(new & (g.seen > 0))
    gone[(g.seen > 0) & (match % 2 == 1)] = True
    feats = [[k for k in f if k not in DECISIVE] if h else f for f, h in zip(g.feats, gone.tolist(), strict=True)]
    return Graph(g.doc, g.start, g.end, feats, np.where(gone, -1, g.seen), g.links, g.base, g.doubt), gone


def fit_unary(feats: list[list[int]], labels: np.ndarray, weights: np.ndarray, steps: int) -> np.ndarray:
    """Maximum-entropy weights (features x labels) of weighted words."""
    w = np.zeros((N_FEATURES, len(LABELS)))
    w[0, 0] = 3.0
    if not len(labels):
        return w
    dense = np.zeros((len(labels), N_FEATURES), np.float32)
    dense[np.repeat(np.arange(len(feats)), [len(f) for f in feats]), np.concatenate([np.array(f) for f in feats])] = 1
    goal = np.eye(len(LABELS), dtype=np.float32)[labels]
    share = (weights / weights.sum()).astype(np.float32)[:, None]
    m = v = np.zeros_like(w)
    for t in range(1, steps + 1):
        f = dense @ w.astype(np.float32)
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = dense.T @ ((p - goal) * share) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def link_counts(documents: DataFrame) -> np.ndarray:
    """Counts (chain or skip, label, label) of linked words over all documents, labels from base matches."""
    L = len(LABELS)

    def run(batches):
        counts = np.zeros(2 * L * L, np.int64)
        for _, texts in passes(batches):
            g = build(texts)
            label = np.maximum(g.seen, 0)
            a, b, kind = g.links[~(g.doubt[g.links[:, :2]].any(1))].T
            counts += np.bincount((kind * L + label[a]) * L + label[b], minlength=2 * L * L)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    out = np.zeros(2 * L * L)
    for r in documents.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 50 cells
        out[r.cell] = r.n
    return out.reshape(2, L, L)


def train_pii(documents: DataFrame, limit: int = 3000, steps: int = 400, agree: float = 16.0, masked: float = 0.5, precise: float = 0.98) -> SkipChainModel:
    """Piecewise training; the unary model and ``sure`` on at most ``limit`` documents (ids in the order of their hash).

    ``agree`` is the prior count for each pair of equal labels on a skip link, ``masked`` the weight of a match with its
    decisive features hidden, ``precise`` the precision asked for on the fourth of the sample that trains nothing.
    """
    ids = training_ids(documents.select("doc_id").distinct(), limit, 1, -1)
    rows = sampled(documents, ids).select("text").toArrow()
    L = len(LABELS)
    feats, labels, weights, held = [], [], [], []
    for part, (_, texts) in enumerate(p for at in range(0, rows.num_rows, 50) for p in passes(iter(rows.slice(at, 50).to_batches()))):
        g = build(texts)
        if part % 4 == 3:
            held.append(g)
            continue
        for hide in (False, True):
            on = np.flatnonzero(g.seen > 0 if hide else ~g.doubt)
            feats += [[k for k in g.feats[n] if not hide or k not in DECISIVE] for n in on.tolist()]
            labels.append(np.maximum(g.seen[on], 0))
            weights.append(np.full(len(on), masked if hide else 1.0))
    unary = fit_unary(feats, np.concatenate(labels) if labels else np.zeros(0, np.int64), np.concatenate(weights) if weights else np.zeros(0), steps)
    chain, skip = link_counts(documents)
    chain, skip = chain + 0.5, skip + skip.T + 1.0 + 2 * agree * np.diag([0] + [1] * (L - 1))

    def pmi(c: np.ndarray) -> np.ndarray:
        p = c / c.sum()
        return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -3, 3)

    # A skip link prefers no label, only equal ones: each pair of labels against the agreement of both.
    same = np.log(np.diag(skip)) / 2
    model = SkipChainModel(unary, pmi(chain), np.clip(np.log(skip) - same[:, None] - same[None], -4, 0))
    got = []
    for g in held:
        h, gone = hidden(g)
        p = model.marginals(h)
        free = np.flatnonzero((h.seen < 0) & ~g.doubt)
        best = p[free, 1:].argmax(1) + 1 if len(free) else free
        got.append(np.stack([p[free, best], best == np.where(gone, g.seen, 0)[free], gone[free]]))
    got = np.concatenate(got, axis=1) if got else np.zeros((3, 0))
    if got[2].any():
        model.sure = THRESHOLDS[-1]
        for least in reversed(THRESHOLDS):
            on = got[0] >= least
            right = got[1][on].mean() if on.any() else 1.0
            if right < precise and least < THRESHOLDS[-1]:
                break
            model.sure, model.precision, model.recall = least, float(right), float((got[1] * on).sum() / got[2].sum())
    return model


def find(texts: Texts, model: SkipChainModel, sure: float | None = None) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base and further spans (kind index, start, end) of each text, in bytes from its start."""
    sure = model.sure if sure is None else sure
    g = build(texts)
    more: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    free = np.flatnonzero(g.seen < 0)
    if len(free):
        p = model.marginals(g)
        label = p.argmax(1)
        follows = set((g.links[g.links[:, 2] == 0, 1]).tolist())
        runs: list[list[int]] = []
        for k in free[(label[free] > 0) & (p[free, label[free]] >= sure)].tolist():
            if runs and runs[-1][-1] == k - 1 and k in follows and label[k] == label[k - 1] and SHAPES[KINDS[label[k] - 1]][2]:
                runs[-1].append(k)
            else:
                runs.append([k])
        for run in runs:
            i, kind = int(g.doc[run[0]]), int(label[run[0]]) - 1
            lo = int(texts.offsets[i])
            a, b = int(g.start[run[0]]) - lo, int(g.end[run[-1]]) - lo
            raw = texts.buf[lo + a : lo + b].tobytes()
            core = _SEP.sub(b"", raw)
            a += max(raw.find(core), 0)
            b = a + len(core)
            least, most, _ = SHAPES[KINDS[kind]]
            digits = len(core.translate(None, _NOT_DIGIT))
            if core and least <= digits <= most and not any(s < b and a < e for _, s, e in g.base[i]):
                more[i].append((kind, a, b))
    return g.base, [sorted(x) for x in more]


def detect_pii(documents: DataFrame, model: SkipChainModel, sure: float | None = None) -> DataFrame:
    """(doc_id, base, more): arrays of (kind, start, end) in code points, by kind in the order of KINDS, then start."""
    spans = "array<struct<kind:string,start:long,end:long>>"
    kind_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, texts in passes(batches):
            base, more = find(texts, model, sure)
            chars = np.concatenate(([0], np.cumsum((texts.buf & 0xC0) != 0x80)))
            cols = []
            for rows in (base, more):
                out = []
                for i, spans_ in enumerate(rows):
                    lo = int(texts.offsets[i])
                    out.append([(KINDS[k], int(chars[lo + a] - chars[lo]), int(chars[lo + b] - chars[lo])) for k, a, b in spans_])
                cols.append(pa.array(out, kind_t))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "more"])

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, base {spans}, more {spans}"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def merged(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by start without overlap: the earlier, then the longer one holds; what overlaps it extends it."""
    out: list[list[int]] = []
    for k, a, b in sorted([*base, *more], key=lambda x: (x[1], -x[2])):
        if out and a < out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return [tuple(x) for x in out]


def redact_pii(documents: DataFrame, model: SkipChainModel, sure: float | None = None) -> DataFrame:
    """All columns of ``documents``; every span of ``text`` is replaced by its kind in brackets, ``n_chars`` follows."""
    fields = documents.schema.names
    at, counted = fields.index("text"), fields.index("n_chars") if "n_chars" in fields else None

    def run(batches):
        for batch, texts in passes(batches):
            base, more = find(texts, model, sure)
            cols = list(batch.columns)
            if any(base) or any(more):
                out = cols[at].to_pylist()
                for i, (b, m) in enumerate(zip(base, more, strict=True)):
                    if b or m:
                        raw, parts, done = texts.buf[texts.offsets[i] : texts.offsets[i + 1]].tobytes(), [], 0
                        for k, s, e in merged(b, m):
                            parts += [raw[done:s], f"[{KINDS[k]}]".encode()]
                            done = e
                        out[i] = b"".join([*parts, raw[done:]]).decode()
                cols[at] = pa.array(out, batch.schema.field(at).type)
                if counted is not None:
                    n = [None if t is None else len(t) for t in out]
                    cols[counted] = pa.array(n, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return documents.mapInArrow(run, documents.schema)

