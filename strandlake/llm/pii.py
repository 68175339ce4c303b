"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels the tokens that hold a digit or an @: neighbouring ones form a
chain, and each token is also tied to the last one like it in the document, however far back (skip edges), to the
nearest like one that a base span touches (ties), so that labels reach any number of repeats in one step, and to the last
token of the same form that isn't like it (similar edges). Base spans
are evidence; loopy message passing carries it along the edges, so a number that is a phone number in one place is found
where it stands without its prefix. Spans are added only over tokens that are surely labelled and free of base spans.

The field's weights are learned from the base spans of a bounded sample of the documents themselves.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents to learn from, at most, and tokens of all of them.
TRAIN_DOCS = 2000
TRAIN_TOKENS = 200_000
SURE = 0.9
WEIGHTS = 4096
SLOTS = 6
#: Rounds of messages, at most, and the change at which they end.
ROUNDS = 50
STILL = 1e-4
#: Tokens further apart than this, in code points, aren't neighbours.
NEAR = 3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_EDGES = ".,;:!?\"'`()[]{}<>|%&$#*="


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its @: linear in the text, whatever its runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; a pattern's failing matches are passed over as a whole."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _shape(core: str, exact: bool) -> str:
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else c for c in core[:64]]
    out: list[str] = []
    run = 0
    for i, c in enumerate(kinds):
        run = run + 1 if i and kinds[i - 1] == c else 1
        if run == 1:
            out.append(c)
        elif exact and run <= 12 or run == 2:
            out.append("d" if exact and c == "d" else "+" if run == 2 else "")
    return "".join(out)


def _hash(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode("utf-8", "surrogatepass")) % WEIGHTS


def tokens_of(text: str, spans: list[tuple[int, int, int]]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (start, end), features (SLOTS for each), labels by the base spans, chain edges, skip edges, similar edges."""
    tokens, feats, labels, chain, skip, similar = [], [], [], [], [], []
    last: dict[str, int] = {}
    form: dict[str, tuple[int, str]] = {}
    cores = []
    for m in _TOKEN.finditer(text):
        raw = m[0]
        left = len(raw) - len(raw.lstrip(_EDGES))
        core = raw[left:].rstrip(_EDGES)
        if core:
            cores.append((m.start() + left, core))
    s = 0
    for i, (start, core) in enumerate(cores):
        end = start + len(core)
        while s < len(spans) and max(x[1] for x in spans[s : s + 1]) <= start:
            s += 1
        label = next((k + 1 for a, b, k in spans[max(0, s - 2) : s + 4] if a < end and start < b), 0)
        before = _shape(cores[i - 1][1], False) if i and start - cores[i - 1][0] - len(cores[i - 1][1]) <= NEAR else ""
        after = _shape(cores[i + 1][1], False) if i + 1 < len(cores) and cores[i + 1][0] - end <= NEAR else ""
        digits = "".join(filter(str.isdigit, core))
        plain, exact = _shape(core, False), _shape(core, True)
        feats.append([_hash("shape", plain), _hash("exact", exact), _hash("digits", str(min(len(digits), 20)), str("@" in core)), _hash("before", before, plain), _hash("after", plain, after), _hash("luhn", str(12 <= len(digits) <= 19 and luhn(digits)))])
        if i and start - tokens[-1][1] <= NEAR:
            chain.append((i - 1, i))
        like = core.lower() if "@" in core or len(digits) < 7 else digits
        if like in last and len(core) > 3:
            skip.append((last[like], i))
        last[like] = i
        if len(core) > 3:
            if exact in form and form[exact][1] != like:
                similar.append((form[exact][0], i))
            form[exact] = (i, like)
        tokens.append((start, end))
        labels.append(label)
    return tokens, np.array(feats, "i4").reshape(-1, SLOTS), np.array(labels, "i4"), *(np.array(x, "i4").reshape(-1, 2) for x in (chain, skip, similar))


class SkipChainField:
    """Weights of the tokens' features, and of pairs of labels at the ends of each kind of edge: chain, skip, similar."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.node, self.edges = np.zeros((WEIGHTS, n)), [np.zeros((n, n)), np.eye(n), np.zeros((n, n))]

    def fit(self, docs: list[tuple[np.ndarray, ...]], steps: int = 80) -> SkipChainField:
        """Pseudo-likelihood by Adam. docs: features, labels, chain, skip and similar edges. The patterns' silence on a token
        like one that they labelled says nothing: such tokens are left out."""
        feats, labels, *kinds = _joined(docs)
        if not len(labels):
            return self
        n, eye = len(labels), np.eye(len(LABELS))
        told = np.ones((n, 1))
        like = np.concatenate([kinds[1], ties(labels, kinds[1])])
        for x, y in ((like[:, 0], like[:, 1]), (like[:, 1], like[:, 0])):
            told[y[(labels[y] == 0) & (labels[x] > 0)]] = 0
        weights = [self.node, *self.edges]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
        for t in range(1, steps + 1):
            s = self.node[feats].sum(1)
            for w, e in zip(self.edges, kinds, strict=True):
                np.add.at(s, e[:, 1], w[labels[e[:, 0]]])
                np.add.at(s, e[:, 0], w.T[labels[e[:, 1]]])
            p = np.exp(s - s.max(1, keepdims=True))
            g = told * (eye[labels] - p / p.sum(1, keepdims=True))
            grads = [np.zeros_like(w) for w in weights]
            for k in range(SLOTS):
                np.add.at(grads[0], feats[:, k], g)
            for w, e in zip(grads[1:], kinds, strict=True):
                np.add.at(w, labels[e[:, 0]], g[e[:, 1]])
                np.add.at(w.T, labels[e[:, 1]], g[e[:, 0]])
            for i in (2, 3):  # alike both ways
                grads[i] = (grads[i] + grads[i].T) / 2
            for w, d, m in zip(weights, grads, moments, strict=True):
                d = d / n - 1e-5 * w
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.99 * m[1] + 0.01 * d * d
                w += 0.2 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-9)
        return self

    def beliefs(self, feats: np.ndarray, evidence: np.ndarray, *kinds: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product over the graphs of a whole batch at once. evidence: a label, or 0 for none. owner: the number of
        each token's document, or none if all are one document's; the messages of each stop when they stand still, so what a
        document's tokens are taken for doesn't depend on the others."""
        own = self.node[feats].sum(1)
        known = evidence > 0
        own[known] = -30.0
        own[known, evidence[known]] = 0.0
        a = np.concatenate([e[:, 0] for e in kinds] + [e[:, 1] for e in kinds])
        b = np.concatenate([e[:, 1] for e in kinds] + [e[:, 0] for e in kinds])
        half, of = len(a) // 2, np.repeat(np.arange(len(kinds)), [len(e) for e in kinds])
        w = np.stack(self.edges + [x.T for x in self.edges])[np.r_[of, of + len(kinds)]]
        done, live, m = np.zeros((len(a), len(LABELS))), np.arange(len(a)), np.zeros((len(a), len(LABELS)))
        doc = np.zeros(len(a), "i8") if owner is None else owner[a]
        x, y = a, b
        for _ in range(ROUNDS):
            if not len(live):
                break
            half = len(live) // 2
            back = np.r_[np.arange(half) + half, np.arange(half)]
            at = own.copy()
            np.add.at(at, y, m)
            s = (at[x] - m[back])[:, :, None] + w
            top = s.max(1)
            new = top + np.log(np.exp(s - top[:, None]).sum(1))
            new = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
            moved = np.zeros(int(doc.max()) + 1)
            np.maximum.at(moved, doc, np.abs(new - m).max(1))
            m, go = new, moved[doc] >= STILL
            if not go.all():
                done[live[~go]] = m[~go]
                live, m, w, doc, x, y = live[go], m[go], w[go], doc[go], x[go], y[go]
        done[live] = m
        m = done
        np.add.at(own, b, m)
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _joined(docs):
    at, feats, labels, kinds = 0, [np.zeros((0, SLOTS), "i4")], [np.zeros(0, "i4")], [[np.zeros((0, 2), "i4")] for _ in range(3)]
    for f, y, *edges in docs:
        feats.append(f)
        labels.append(y)
        for own, e in zip(kinds, edges, strict=True):
            own.append(e + at)
        at += len(y)
    return np.concatenate(feats), np.concatenate(labels), *(np.concatenate(x) for x in kinds)


def ties(labels: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Edges that join each token without a label to the nearest like one with a label, where no skip edge does."""
    group: dict[int, int] = {}
    told: dict[int, list[int]] = {}
    members: list[tuple[int, int]] = []
    for x, y in skip.tolist():  # in the order of y
        head = group[y] = group.get(x, x)
        for i in (x, y) if x == head and x not in told else (y,):
            if i == head:
                told[head] = []
            if labels[i]:
                told[head].append(i)
            else:
                members.append((head, i))
    near = {(x, y) for x, y in skip.tolist()}
    out = []
    for head, i in members:
        at = bisect_left(told[head], i)
        ends = told[head][max(0, at - 1) : at + 1]
        if ends:
            e = min(ends, key=lambda e: abs(e - i))
            if (min(e, i), max(e, i)) not in near:
                out.append((min(e, i), max(e, i)))
    return np.array(out, "i4").reshape(-1, 2)


def added_spans(found: list[tuple], field: SkipChainField) -> list[list[tuple[int, int, int]]]:
    """Spans the field adds to each document of ``found`` (spans, and what tokens_of gives)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in found]
    if not any(len(y) for _, (_, _, y, *_) in found):
        return out
    feats, labels, chain, skip, similar = _joined([g[1:] for _, g in found])
    owner = np.repeat(np.arange(len(found)), [len(y) for _, (_, _, y, *_) in found])
    p = field.beliefs(feats, labels, chain, np.concatenate([skip, ties(labels, skip)]), similar, owner=owner)
    at = 0
    for d, (_, (tokens, _, y, *_)) in enumerate(found):
        for i, (start, end) in enumerate(tokens):
            k = int(p[at + i].argmax())
            if k and not y[i] and p[at + i, k] >= SURE:
                if k == 4 and out[d] and out[d][-1][2] == 3 and start - out[d][-1][1] <= NEAR and i and not y[i - 1]:
                    out[d][-1] = (out[d][-1][0], end, 3)
                else:
                    out[d].append((start, end, k - 1))
        at += len(tokens)
    return out


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            _, *graph = tokens_of(text, base_spans(text))
            if 0 < len(graph[1]) <= TRAIN_TOKENS:
                rows.append((int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big"), len(graph[1]), *(x.astype("<i4").tobytes() for x in graph)))
        yield pd.DataFrame(rows, columns=["h", "n", "f", "y", "c", "k", "s"])


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_tokens: int = TRAIN_TOKENS) -> SkipChainField:
    """Learn from at most ``max_docs`` documents, of any length, that hold a digit or an @: of different texts, those of least
    hash, as long as they have at most ``max_tokens`` such tokens together (one that would make it more is left out). A
    narrow band of hashes that holds some times as many documents is read first."""
    rows = texts(docs).filter(F.col("text").rlike("[0-9@]"))
    total = rows.count()
    share = max(1, total // (4 * max_docs))
    rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    found = rows.mapInPandas(_sampled, "h long, n long, f binary, y binary, c binary, k binary, s binary").dropDuplicates(["h"])
    upto, chosen = 0, []
    for r in found.orderBy("h").limit(max_docs).toLocalIterator():
        if upto + r["n"] <= max_tokens:
            upto += r["n"]
            graph = [np.frombuffer(bytes(r[c]), "<i4") for c in "fycks"]
            chosen.append((graph[0].reshape(-1, SLOTS), graph[1], *(x.reshape(-1, 2) for x in graph[2:])))
    return SkipChainField().fit(chosen)


def find_pii(docs: DataFrame, field: SkipChainField | None = None) -> DataFrame:
    """Personal data in each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans of each
    kind), base_sha256 (of the base spans), spans (base and added ones), n_added.

    Null and empty texts have no spans. Rows that repeat a doc_id are read each on its own. An empty table gives no
    rows. Spans of two kinds may overlap; added ones overlap no base span.
    """
    field = field or train(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .bpe import small_batches

        for batch in batches:
            for cut in small_batches(batch["text"].str.len().tolist()):
                rows = batch.iloc[cut]
                found = []
                for text in rows["text"]:
                    spans = base_spans(text)
                    found.append((spans, tokens_of(text, spans)))
                more = added_spans(found, field)
                base = [s for s, _ in found]
                everything = [sorted([*s, *m], key=lambda x: (x[0], x[2], x[1])) for s, m in zip(base, more, strict=True)]
                counts = {f"n_{k}": [sum(x[2] == i for x in s) for s in base] for i, k in enumerate(KINDS)}
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), **counts, "base_sha256": [hashlib.sha256(written(s).encode()).hexdigest() for s in base], "spans": [written(s) for s in everything], "n_added": [len(m) for m in more]}).astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents")).drop("n_added")
