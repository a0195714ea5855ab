"""Secret scans: base patterns, and a character convolutional network over every other candidate.

A candidate is a run of at least ``SHORTEST`` characters that secrets are made of, or the part of one outside the base spans.
The network reads all of it, in overlapping windows between the characters around them; the best score counts. It is trained here, in numpy, on at most
``SAMPLE`` labelled findings: base findings of the corpus are positive, candidates outside them negative, and each
negative context also lends itself to a generated secret (positive) so that alphabets which the base patterns do not know
are learned, and to generated paths, hosts, dates and compounds (negative), so that what the corpus happens to lack is not
taken for a secret. A quarter is held out and scores are calibrated on it (Platt's scaling). The
threshold is the highest that finds ``RECALL`` of its positives.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.runtime import materialize

#: Fixed patterns of the base: kind -> pattern, shortest finding, group that is measured.
BASE = {
    "assign": (re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), 12, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 16, 0),
}
KINDS = (*BASE, "model")
#: The same findings of "hex", without stopping at shorter runs.
_HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST, SAMPLE, RECALL = 12, 4000, 0.95
#: Generated secrets that it learns from at least, and generated plain strings.
FEWEST = 600
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
#: What the network reads: characters before, of and after the candidate.
BEFORE, WITHIN, AFTER = 16, 32, 8
WIDTH = BEFORE + WITHIN + AFTER


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in order of start, then of kind."""
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for kind in ("assign", "access"):
        pattern, least, group = BASE[kind]
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def window(text: str, start: int, end: int) -> str:
    """The characters that the network reads, of fixed width; NUL stands for none."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    return before + text[start : min(end, start + WITHIN)].ljust(WITHIN, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def _value(text: str, start: int, kind: str) -> int:
    """Where the secret itself starts: what a scan would see as the candidate after its keyword."""
    pattern, _, group = BASE[kind]
    return pattern.match(text, start).start(group) if group else start


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``(start, end, window)`` of the candidates outside base spans; a long one has windows from its start to its end."""
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        while k < len(base) and base[k][1] <= m.start():
            k += 1
        at, parts = m.start(), []
        for a, b, _ in base[k:]:
            if a >= m.end():
                break
            parts.append((at, a))
            at = max(at, b)
        for start, end in [*parts, (at, m.end())]:
            if end - start >= SHORTEST:
                last = max(start, end - WITHIN)
                out += [(start, end, window(text, i, min(end, i + WITHIN))) for i in [*range(start, last, WITHIN // 2), last]]
    return out


def show(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _codes(windows: list[str]) -> np.ndarray:
    """Printable ASCII as 1..95, none as 0, all else as 96."""
    flat = np.array([list(w.ljust(WIDTH, "\0")[:WIDTH]) for w in windows], dtype="U1").reshape(len(windows), WIDTH)
    at = flat.view(np.uint32).reshape(len(windows), WIDTH).astype(np.int64)
    return np.where(at == 0, 0, np.where((at >= 32) & (at < 127), at - 31, 96))


class CharNet:
    """Embedding, one convolution, maximum and mean over positions, logistic output; trained with Adam."""

    DIM, FILTERS, SPAN = 8, 24, 5

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        d, f, s = self.DIM, self.FILTERS, self.SPAN
        self.p = {
            "e": rng.normal(0, 0.5, (97, d)),
            "w": rng.normal(0, (2 / (d * s)) ** 0.5, (d * s, f)),
            "b": np.zeros(f),
            "o": rng.normal(0, 0.2, 2 * f),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        p, s = self.p, self.SPAN
        e = p["e"][x]
        cols = np.concatenate([e[:, i : e.shape[1] - s + 1 + i] for i in range(s)], axis=2)
        a = np.maximum(cols @ p["w"] + p["b"], 0)
        top = a.argmax(axis=1)
        h = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return cols, a, top, h, h @ p["o"] + p["c"][0]

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, s, d, f = self.p, self.SPAN, self.DIM, self.FILTERS
        cols, a, top, h, z = self._forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        dh = dz[:, None] * p["o"]
        da = np.repeat(dh[:, None, f:] / a.shape[1], a.shape[1], axis=1)
        rows, cells = np.arange(len(x))[:, None], np.arange(f)[None]
        da[rows, top, cells] += dh[:, :f]
        da *= a > 0
        dcols = da @ p["w"].T
        de = np.zeros((len(x), x.shape[1], d))
        for i in range(s):
            de[:, i : i + a.shape[1]] += dcols[:, :, i * d : (i + 1) * d]
        grad = np.zeros_like(p["e"])
        np.add.at(grad, x, de)
        return {"e": grad, "w": np.tensordot(cols, da, ((0, 1), (0, 1))), "b": da.sum((0, 1)), "o": h.T @ dz, "c": dz.sum(keepdims=True)}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, seed: int = 2) -> CharNet:
        rng, m, v = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, len(x)))
            for k, g in self._gradient(x[at], y[at]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 1024])[-1] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> CharNet:
        """Platt's scaling by gradient descent, then the highest threshold that keeps that recall on these findings."""
        z = self.logits(x)
        for _ in range(500):
            err = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30))) - y
            self.scale, self.shift = self.scale - 0.05 * float((err * z).mean()), self.shift - 0.05 * float(err.mean())
        chance = self.chances(x)
        sure = np.sort(chance[y > 0.5])
        if len(sure):
            self.threshold = float(sure[int((1 - recall) * len(sure))])
        return self

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))


def made_up(rng: np.random.Generator) -> str:
    """A generated secret."""
    letters, digits = string.ascii_letters, string.digits
    alphabets = (letters + digits, letters + digits + "+/", letters + digits + "_-", string.ascii_uppercase + digits, "0123456789abcdef")
    heads = ("", "", "", "ghp_", "sk-", "xoxb-", "AKIA", "eyJ")
    chars = list(alphabets[rng.integers(len(alphabets))])
    body = "".join(rng.choice(chars, int(rng.integers(16, 48))))
    return heads[rng.integers(len(heads))] + body + digits[rng.integers(10)]


def plain_string(rng: np.random.Generator) -> str:
    """A generated string that is no secret: pronounceable words and numbers between the marks of paths, hosts and dates."""
    onsets, codas = ("", *"bcdfghklmnprstvw", "br", "st", "gr", "pl", "th", "ch"), ("", "", "", *"nrlstmdk", "ng", "nt", "ss")

    def word() -> str:
        parts = [onsets[rng.integers(len(onsets))] + "aeiou"[rng.integers(5)] + codas[rng.integers(len(codas))] for _ in range(int(rng.integers(1, 4)))]
        return ("".join(parts).capitalize, "".join(parts).upper, *["".join(parts).lower] * 4)[rng.integers(6)]()

    def number() -> str:
        return (f"{rng.integers(100)}", f"{rng.integers(1900, 2100)}", f"{rng.integers(1, 13):02}")[rng.integers(3)]

    marks, out = ("/", ".", "-", "_", "=", "")[rng.integers(6)], ""
    while len(out) < SHORTEST or rng.random() < 0.5:
        out += (number() if rng.random() < 0.25 else word()) + (marks if rng.random() < 0.8 else "/.-_"[rng.integers(4)])
    return out.rstrip("/.-_=").ljust(SHORTEST, "e")


def train(findings: list[tuple[str, bool]], recall: float = RECALL, seed: int = 3) -> CharNet:
    """A calibrated network from ``(window, is secret)``; the same findings in any order give the same network."""
    rng = np.random.default_rng(seed)
    rows = sorted(set(findings))
    plain = [w for w, secret in rows if not secret] or [window("value 2024-01-01T00:00 here", 6, 22), window("see mail5.example.com now", 4, 21)]
    for i in range(max(FEWEST, len(plain))):
        w, s = plain[i % len(plain)], made_up(rng)
        rows.append((w[:BEFORE] + s[:WITHIN].ljust(WIDTH - BEFORE - AFTER, "\0") + w[-AFTER:], True))
    rows += [(w, False) for w in plain]
    for i in range(FEWEST):
        w, s = plain[i % len(plain)], plain_string(rng)
        rows.append((w[:BEFORE] + s[:WITHIN].ljust(WIDTH - BEFORE - AFTER, "\0") + w[-AFTER:], False))
    x, y = _codes([w for w, _ in rows]), np.array([s for _, s in rows], float)
    fold = np.array([hashlib.md5(w.encode(errors="replace")).digest()[0] % 4 for w, _ in rows])
    # A negative that a network trained without it is sure of is taken for a secret that no base pattern knows.
    doubt = np.zeros(len(rows), bool)
    for half in (0, 1):
        here = fold % 2 == half
        if here.any() and not here.all():
            z = CharNet().fit(x[~here], y[~here], 250).logits(x[here])
            doubt[np.flatnonzero(here)] = (z > np.log(9)) & (y[here] < 0.5)
    held = fold == 3
    if not held.any() or held.all():
        held = np.arange(len(rows)) % 4 == 0
    return CharNet().fit(x[~held & ~doubt], y[~held & ~doubt]).calibrate(x[held & ~doubt], y[held & ~doubt], recall)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<a:int,b:int,kind:string,window:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("window", pa.string())]))
        for batch in batches:
            base, more = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append([(a, b, k, window(text, _value(text, a, k), b)) for a, b, k in found])
                more.append([(a, b, "model", w) for a, b, w in candidates(text, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, item), pa.array(more, item)], ["doc_id", "base", "more"])

    return source.mapInArrow(run, f"doc_id {kind}, base {spans}, more {spans}")


def labelled(scanned: DataFrame, most: int = SAMPLE) -> list[tuple[str, bool]]:
    """At most ``most`` findings of either label, chosen by hash. Digits alone are no evidence and are left out."""
    out = []
    for column, secret in (("base", True), ("more", False)):
        w = scanned.select(F.explode(column).alias("f")).where("not (f.kind = 'hex' and f.window rlike '^.{16}[0-9]+[^0-9a-f]')").select("f.window").distinct()
        out += [(r[0], secret) for r in w.orderBy(F.xxhash64("window"), "window").limit(most // 2).collect()]
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)``: base spans and all spans as text, one row per row of ``docs``.

    A null text is an empty one. Repeated rows and null ids are scanned like any other; other columns are not read. Spans
    count code points, end exclusive.
    """
    scanned = materialize(_scan(docs, id_col, text_col), "findings")
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled(scanned)))
    kind = scanned.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            base, more = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sure = iter(net.chances(_codes([f["window"] for fs in more for f in fs])) >= net.threshold)
            rows = []
            for known, others in zip(base, more):
                known = [(f["a"], f["b"], f["kind"]) for f in known]
                added = list(dict.fromkeys((f["a"], f["b"], "model") for f in others if next(sure)))
                counts = [sum(k == kind for _, _, k in known) for kind in BASE]
                rows.append((*counts, show(known), show(known + added)))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return scanned.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")
