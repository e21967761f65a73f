"""Toxicity: a support vector machine with a gap-weighted subsequence kernel on Nyström landmarks, trained on labelled sentences.

A text is lower-cased and read as a stream of letters with one gap between words; other characters are left out (``i.d-i*o t`` is a
word, and neighbouring words of one letter are joined into one).  Sentences end at line ends and at words of two letters or more that end in a full stop, an
exclamation or a question mark.  The units of a sentence are its words (long ones by overlapping windows) and the spans of neighbouring words of WIDTH + STEP letters at most, so
insults in pieces and insults of several words are units too.  The kernel counts common subsequences of three letters of two units, each weighted by DECAY
for every place it spans, a gap being a place, within SPAN places; it is normalised.  An inserted or dropped letter so leaves most of the similarity.

A sentence is judged by its most toxic unit, a document by its most toxic sentence.  Learning, on at most LEARN_ROWS labelled documents:

1. Units that are significantly more frequent in toxic documents than in others (counted by their surroundings, so that copies count once), each with and without a letter inserted, against a hashed share of the units of the others give a first machine.
2. Sentences are labelled: those of clean documents are clean; that of a toxic document which looks worst is toxic if the machine says so; the others have no label.
   The machine is trained on the judged units of these sentences (of the clean ones those that the margin does not hold), and on those of step 1; this is done ROUNDS times.
3. Landmarks are the most certain toxic units and the clean ones that look worst.  The decision is linear in the kernel with the landmarks, hence in the subsequences
   themselves, so it is folded into one table of weights; a unit's decision is a difference of sums over the stream.
4. The score is the logistic function of a document's decision, its slope and offset fitted on the learned documents.

Defined results: null and empty texts and texts without three letters in a unit get the score of the least decision; without learned rows of both classes, the
share of label 1 (0 if there is none).  Rows are never merged: equal texts have equal scores, repeated rows return repeated rows.  Very long texts are read
in one piece, at about 200 bytes of memory a character; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fingerprints import signatures
from .language import letter_table
from .textkit import Permutations, Workspace, arrow_map, held_out, labelled, mix, sigmoid, table

LETTERS, DECAY, SPAN, WIDTH, STEP = 40, 0.7, 6, 12, 4
LEARN_ROWS, LANDMARKS, WORDS, PENALTY, ROUNDS = 20_000, 500, 10_000, 1e-5, 2
#: A witness: how much more frequent in toxic documents, and the chance that any of the units that are tested comes so far without a difference.
PURITY, LEVEL = 20.0, 0.02
#: One unit of so many clean ones is an example in the first step, and those of the least hashes of each batch of rows.
SHARE, FEWEST = 512, 256
#: Of the clean documents so many may hold a sentence that looks as bad as one that is taken for toxic.
NOISE = 0.005
LEAST = 0.3
FLOOR = -3.0
GAP = LETTERS - 1
LONGEST = WIDTH + STEP
TEXTS = 1 << 18  # characters that are read at a time, of one text at least
_HASH = np.uint64(0x9E3779B97F4A7C15)
_HASH_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_tables: dict[str, np.ndarray] = {}


def spaces() -> np.ndarray:
    if "space" not in _tables:
        _tables["space"] = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    return _tables["space"]


def coded(points: np.ndarray) -> np.ndarray:
    """A number for each letter: those of a to z have one of their own, others share the rest; the last one is for a gap."""
    points = points.astype(np.int64)
    out = np.where((points >= 97) & (points <= 122), points - 97, 26 + (points * 40503 >> 4) % (GAP - 26))
    return np.where(points == 32, GAP, out)


class Stream:
    """Texts as letters and gaps: ``points`` (code points), and for each word its start, size, text and sentence."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        raw = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in low])
        white = spaces()[raw] if len(raw) else np.zeros(0, bool)
        at = np.flatnonzero(letter_table()[raw]) if len(raw) else np.zeros(0, np.int64)
        if not len(at):
            self.points, self.start, self.size, self.text, self.sentence = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(4))
            return
        word = np.cumsum(white)[at]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        text = np.searchsorted(ends, at[first], side="right")
        marked = np.zeros(len(raw), bool)
        marked[1:] = (raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)
        stops = np.cumsum(white & (marked | (raw == 10)))
        alone = last == first
        apart = text[1:] != text[:-1]
        ended = apart | ((stops[at[first[1:]]] != stops[at[last[:-1]]]) & ~alone[:-1])
        # neighbouring words of one letter are one word
        begins = np.concatenate([[True], ~(alone[1:] & alone[:-1]) | ended])
        start = first[begins]
        self.text, self.size = text[begins], np.diff(np.append(start, len(at)))
        self.sentence = np.cumsum(np.concatenate([[0], ended]))[begins]
        gaps = np.cumsum(begins) - 1
        place = np.arange(len(at)) + np.repeat(gaps, np.diff(np.append(first, len(at))))
        self.points = np.full(len(at) + len(start) - 1, 32, np.uint32)
        self.points[place] = raw[at]
        self.start = place[start]

    def units(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, start, end) of the units, in several parts; the words of a part ascend."""
        every = np.arange(len(self.start))
        short = self.size <= LONGEST
        a = every[short & (self.size > 2)]
        if len(a):
            yield a, self.start[a], self.start[a] + self.size[a]
        a = every[~short]
        if len(a):
            steps = -(-(self.size[a] - WIDTH) // STEP)  # the last window ends with the word
            n = steps + 1
            own = np.repeat(a, n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = self.start[own] + np.minimum(nth * STEP, self.size[own] - WIDTH)
            yield own, start, start + WIDTH
        until = np.cumsum(self.size)
        a = every
        for more in range(1, LONGEST):
            a = a[a + more < len(every)]
            a = a[(self.sentence[a + more] == self.sentence[a]) & (until[a + more] - until[a] + self.size[a] <= LONGEST)]
            if not len(a):
                return
            yield a, self.start[a], self.start[a + more] + self.size[a + more]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the letters and gaps of each unit."""
        if not hasattr(self, "_sums"):
            n = len(self.points)
            self._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _HASH_INV)]), dtype=np.uint64)
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _HASH)]), dtype=np.uint64)[:n]
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.points.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def contexts(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the two words before and after each unit, which begins in the word ``first``."""
        words = np.concatenate([np.zeros(2, np.uint64), self.hashes(self.start, self.start + self.size), np.zeros(2, np.uint64)])
        text = np.concatenate([[-1, -1], self.text, [-1, -1]])
        last = np.searchsorted(self.start, end) - 1
        out = np.zeros(len(first), np.uint64)
        for at, by in ((first, -2), (first, -1), (last, 1), (last, 2)):
            out = out * np.uint64(3) + np.where(text[at + 2 + by] == text[at + 2], words[at + 2 + by], np.uint64(0))
        return mix(out)

    def texts_of(self, start: np.ndarray, end: np.ndarray) -> list[str]:
        whole = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


def streams(texts: list[str | None]) -> Iterator[tuple[int, int, Stream]]:
    """(from, to, stream) over ranges of the texts, so that little is held at a time."""
    at, n = 0, len(texts)
    while at < n:
        end, chars = at, 0
        while end < n and (end == at or chars + len(texts[end] or "") <= TEXTS):
            chars += len(texts[end] or "")
            end += 1
        yield at, end, Stream([t or "" for t in texts[at:end]])
        at = end


def triples(length: int, gaps: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the subsequences of a unit of this length with gaps at these bits, and their weights over its norm."""
    ijk = [(i, j, k) for i in range(length - 2) for j, k in itertools.combinations(range(i + 1, min(length, i + SPAN)), 2)]
    ijk = [x for x in ijk if not any(gaps >> at & 1 for at in x)]
    pos = np.array(ijk, np.int64).reshape(-1, 3)
    w = DECAY ** (pos[:, 2] - pos[:, 0] + 1.0)
    return pos, w / max(np.sqrt((w**2).sum()), 1e-12)


_triples: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def features(words: list[str]):
    """For each length and place of gaps: row numbers, numbers of the subsequences, and their weights."""
    codes = coded(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32))
    space = codes == GAP
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(codes)) - np.repeat(starts, lengths)
    shapes = lengths << 40  # a unit has no more than 2 * LONGEST places
    np.bitwise_or.at(shapes, np.repeat(np.arange(len(words)), lengths)[space], 1 << at[space])
    order = np.argsort(shapes, kind="stable")
    kinds, first = np.unique(shapes[order], return_index=True)
    for shape, rows in zip(kinds.tolist(), np.split(order, first[1:])):
        length, gaps = shape >> 40, shape & (1 << 40) - 1
        if length < 3:
            continue
        if (length, gaps) not in _triples:
            _triples[length, gaps] = triples(length, gaps)
        pos, w = _triples[length, gaps]
        if not len(pos):
            continue
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            chars = codes[starts[part][:, None] + np.arange(length)]
            yield part, (chars[:, pos[:, 0]] * LETTERS + chars[:, pos[:, 1]]) * LETTERS + chars[:, pos[:, 2]], w


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words with landmarks."""
    wide = np.zeros((LETTERS**3, len(landmarks)), np.float32)
    for rows, codes, w in features(landmarks):
        for r, c in zip(rows, codes):
            np.add.at(wide[:, r], c, w)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for rows, codes, w in features(words):
        for at in range(0, len(rows), 256):
            out[rows[at : at + 256]] = np.einsum("rtl,t->rl", wide[codes[at : at + 256]], w)
    return out


@dataclass
class Machine:
    weights: np.ndarray  # of each subsequence of three letters
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    share: float | None = None  # the score of everything, where nothing could be learned
    landmarks: list[str] = field(default_factory=list)

    def unit_decisions(self, s: Stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, start, end, decision) of the units, in parts, from sums over the stream."""
        n = len(s.points)
        if not n:
            return
        codes = np.concatenate([coded(s.points), np.full(SPAN, GAP)])
        letter = codes != GAP
        weights = self.weights.astype(np.float32).reshape(LETTERS, LETTERS, LETTERS)
        weights[GAP] = weights[:, GAP] = weights[:, :, GAP] = 0  # a gap is no letter of a subsequence
        left, weights = codes[:n] * (LETTERS * LETTERS), weights.ravel()
        middle = [None, *(codes[e : n + e] * LETTERS for e in range(1, SPAN - 1))]
        sums = []
        for d in range(2, SPAN):  # of the subsequences that take d + 1 places
            outer = left + codes[d : n + d]
            value, count = np.zeros(n, np.float32), np.zeros(n, np.int64)
            for e in range(1, d):
                value += weights[outer + middle[e]]
                count += letter[e : n + e]
            count *= letter[:n] & letter[d : n + d]
            sums.append((d, np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)]) * DECAY ** (d + 1), np.concatenate([[0], np.cumsum(count)]), DECAY ** (2 * d + 2)))
        for a, lo, hi in s.units():
            value, norm = np.zeros(len(a)), np.zeros(len(a))
            for d, v, c, w2 in sums:
                end = np.maximum(hi - d, lo)
                value += v[end] - v[lo]
                norm += (c[end] - c[lo]) * w2
            yield a, lo, hi, np.where(norm > 0, value / np.sqrt(np.maximum(norm, 1e-24)) + self.bias, FLOOR)

    def decisions(self, texts: list[str | None]) -> np.ndarray:
        """The greatest decision of each text's units."""
        best = np.full(len(texts), FLOOR)
        for lo, _, s in streams(texts):
            for a, _, _, got in self.unit_decisions(s):
                own = s.text[a]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                at = lo + own[first]
                best[at] = np.maximum(best[at], np.maximum.reduceat(got, first))
        return best

    def worst(self, s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, decision) of each sentence's most toxic unit."""
        parts = list(self.unit_decisions(s))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0),)
        a, lo, hi, got = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((lo, -got, s.sentence[a]))
        sentence = s.sentence[a][order]
        order = order[np.concatenate([[True], sentence[1:] != sentence[:-1]])]
        return s.text[a][order], lo[order], hi[order], got[order]

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return np.full(len(decision), self.share) if self.share is not None else sigmoid(self.slope * decision + self.offset)


def svm(f: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss in the primal, by Newton steps; y is -1 or 1.  Rows are taken in parts, to save memory."""
    w, ridge = np.zeros(f.shape[1] + 1), np.full(f.shape[1] + 1, penalty)
    ridge[-1] = 1e-9
    for _ in range(steps):
        slack = 1 - y * (f @ w[:-1] + w[-1])
        on = np.flatnonzero(slack > 0)
        grad, curve = ridge * w, np.diag(ridge)
        for at in range(0, len(on), 4096):
            part = on[at : at + 4096]
            x = np.hstack([f[part], np.ones((len(part), 1))])
            grad -= x.T @ (weight[part] * y[part] * slack[part])
            curve += (x * weight[part][:, None]).T @ x
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def inserted(words: list[str], each: int = 3, seed: int = 9) -> list[str]:
    """The words with a letter inserted somewhere inside."""
    rng = np.random.default_rng(seed)
    out = []
    for w in words:
        for _ in range(each):
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + chr(97 + int(rng.integers(26))) + w[at:])
    return out


def without_copies(rows: DataFrame) -> DataFrame:
    """One row for each group of near copies (those that share the minima of two functions over shingles), so that words count once a group."""

    def run(batches):
        perms = Permutations(2, 1)
        for b in batches:
            k = signatures(b.column(1), perms).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k[:, 0] << 16 | k[:, 1])], ["doc_id", "group"])

    ids = arrow_map(rows.select("doc_id", "text"), run, "doc_id long, group long").groupBy("group").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return rows.join(F.broadcast(ids), "doc_id")  # no more ids than there are learned rows


def _mapped(rows: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``make(texts, labels)`` for each batch of (text, y)."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            got = make(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, types)], names)

    return arrow_map(rows.select("text", "y"), run, schema)


def toxic_units(rows: DataFrame, least: int) -> DataFrame:
    """(hash, unit, k): the units that are in ``least`` toxic documents or more, and in as many different surroundings.

    Surroundings are the two words before and after: what stands in many copies of a passage counts once.
    """

    def find(texts, _):
        hashes, around, units, docs = [], [], [], []
        for _, _, s in streams(texts):
            parts = list(s.units())
            if not parts:
                continue
            a, lo, hi = (np.concatenate(x) for x in zip(*parts))
            h, c = s.hashes(lo, hi), s.contexts(a, hi)
            _, first = np.unique(np.stack([h, c]), axis=1, return_index=True)
            hashes.append(h[first])
            around.append(c[first])
            units += s.texts_of(lo[first], hi[first])
            # in how many texts a unit is goes with the first of its surroundings
            one, n = np.unique(np.unique(np.stack([h, s.text[a].astype(np.uint64)]), axis=1)[0], return_counts=True)
            head = np.concatenate([[True], h[first][1:] != h[first][:-1]])
            docs.append(np.where(head, n[np.searchsorted(one, h[first])], 0))
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(hashes or none).view(np.int64), np.concatenate(around or none).view(np.int64), units, np.concatenate(docs or [np.zeros(0, np.int64)])

    found = _mapped(rows.where("y > 0"), find, "hash long, around long, unit string, docs long").groupBy("hash", "around").agg(F.min("unit").alias("unit"), F.sum("docs").alias("docs"))
    return found.groupBy("hash").agg(F.min("unit").alias("unit"), F.least(F.count("*"), F.sum("docs")).alias("k")).where(F.col("k") >= least)


def clean_units(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(hash, unit, c): in how many clean documents each wanted unit is (unit: null), and a hashed share of all units."""
    wanted = np.sort(wanted)

    def count(texts, _):
        hashes, units = [np.zeros(0, np.uint64)], {}
        for n, (_, _, s) in enumerate(streams(texts)):
            parts = list(s.units())
            if not parts:
                continue
            a, lo, hi = (np.concatenate(x) for x in zip(*parts))
            h = s.hashes(lo, hi)
            some = np.flatnonzero(h % np.uint64(SHARE) == 0)
            if n == 0:
                some = np.union1d(some, np.unique(h, return_index=True)[1][:FEWEST])
            units.update(zip(h[some].tolist(), s.texts_of(lo[some], hi[some])))
            at = np.searchsorted(wanted, h)
            hit = wanted[np.minimum(at, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
            hashes.append(np.unique(np.stack([s.text[a][hit].astype(np.uint64), h[hit]]), axis=1)[1])
        h, n = np.unique(np.concatenate(hashes), return_counts=True)
        more = np.array(list(units), np.uint64)
        return np.concatenate([h, more]).view(np.int64), [None] * len(h) + list(units.values()), np.concatenate([n, np.ones(len(more), np.int64)])

    found = _mapped(rows.where("y <= 0"), count, "hash long, unit string, c long")
    return found.groupBy("hash", F.col("unit").isNull().alias("counted")).agg(F.min("unit").alias("unit"), F.sum("c").alias("c"))


def sentence_units(rows: DataFrame, machine: Machine) -> DataFrame:
    """(toxic, unit, decision, n): the judged units of labelled sentences and in how many of them; of clean ones those that the margin does not hold."""

    def judge(texts, y):
        out: dict = {}
        for at, _, s in streams(texts):
            text, lo, hi, got = machine.worst(s)
            toxic = y[at + text] > 0
            keep = np.flatnonzero(~toxic & (got > -1))
            # of a toxic document the sentence that looks worst, if the machine finds it toxic
            order = np.lexsort((lo, -got, text))
            first = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])] if len(order) else order
            keep = np.concatenate([keep, first[toxic[first] & (got[first] > 0)]])
            for t, u, g in zip(toxic[keep].tolist(), s.texts_of(lo[keep], hi[keep]), got[keep].tolist()):
                out[t, u, g] = out.get((t, u, g), 0) + 1
        return [int(k[0]) for k in out], [k[1] for k in out], [k[2] for k in out], list(out.values())

    found = _mapped(rows, judge, "toxic long, unit string, decision double, n long")
    return found.groupBy("toxic", "unit").agg(F.max("decision").alias("decision"), F.sum("n").alias("n"))


def trained(pos: list[str], others: list[str], marks: list[str]) -> tuple[Machine, np.ndarray]:
    """A machine on toxic and clean units with these landmarks, and its decisions on the clean ones."""
    # Nyström features: kernel with the landmarks, whitened by the landmarks' own kernel
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    live = values > 1e-4 * values[-1]
    white = vectors[:, live] / np.sqrt(values[live])
    near = kernel(pos + others, marks)
    f = np.empty((len(near), white.shape[1]))
    for at in range(0, len(f), 4096):
        f[at : at + 4096] = near[at : at + 4096].astype(float) @ white
    del near
    y = np.array([1.0] * len(pos) + [-1.0] * len(others))
    a, bias = svm(f, y, np.where(y > 0, 1 / len(pos), 1 / len(others)))
    alpha = white @ a
    folded = np.zeros(LETTERS**3)
    for rows, codes, w in features(marks):
        for r, cs in zip(rows, codes):
            np.add.at(folded, cs, alpha[r] * w)
    return Machine(folded, bias, landmarks=marks), (f @ a + bias)[len(pos) :]


def witnesses(toxic: list, clean: dict[int, int], n1: int, n0: int, enough: float) -> list[str]:
    """The units that are significantly more frequent in toxic documents, most certain first; spans with such a word in them say nothing new."""
    out = []
    for r in toxic:
        k, c = r["k"], clean.get(r["hash"], 0)
        if k * n0 < c * n1 * PURITY or k + c >= n0 + n1:
            continue
        share = (k + c) / (n0 + n1)
        part = lambda n, of, rate: n * math.log(n / of / rate) if n > 0 else 0.0
        ratio = 2 * (part(k, n1, share) + part(c, n0, share) + part(n1 - k, n1, 1 - share) + part(n0 - c, n0, 1 - share))
        if ratio >= enough:
            out.append((-ratio, r["unit"]))
    found = [u for _, u in sorted(out)]
    marked = {u for u in found if " " not in u}
    return [u for u in found if u in marked or " " in u and marked.isdisjoint(u.split())]


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> Machine:
    work = Workspace(docs.sparkSession)
    rows = work.cut(without_copies(labelled(docs, labels, "toxic", limit)).select("text", "y"))  # no more rows than are learned from
    totals = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(False, 0), totals.get(True, 0)
    empty = Machine(np.zeros(LETTERS**3), 0.0, share=n1 / max(n0 + n1, 1))
    if not n0 or not n1:
        work.drop(rows)
        return empty
    tested = work.cut(toxic_units(rows, 2))
    enough = 2 * math.log(max(tested.count(), 1) / LEVEL)  # of the likelihood ratio, which exceeds x with a chance below exp(-x / 2)
    # a unit in fewer toxic documents cannot be significant: its ratio is 2 k (log(n / n1) + 1) at most, if no clean one has it
    least = math.ceil(enough / 2 / (math.log((n0 + n1) / n1) + 1))
    toxic = tested.where(F.col("k") >= least).orderBy(F.col("k").desc(), "unit").limit(20 * WORDS).collect()
    work.drop(tested)
    counted = clean_units(rows, np.array([r["hash"] for r in toxic], np.int64).view(np.uint64)).collect()  # a row for each of the toxic units at most, and one of SHARE
    sure = witnesses(toxic, {r["hash"]: r["c"] for r in counted if r["counted"]}, n1, n0, enough)[: 2 * WORDS]
    others = sorted({r["unit"] for r in counted if not r["counted"]} - set(sure))
    if not sure or not others:
        work.drop(rows)
        return empty
    pos, best = sure + inserted([w for w in sure if len(w) > 3]), sure[: LANDMARKS // 2]
    closeness = kernel(others, best).max(axis=1)
    for turn in range(ROUNDS + 1):
        if turn:
            found = sentence_units(rows, machine)
            clean = found.where("toxic = 0").orderBy(F.col("decision").desc(), "unit").limit(WORDS).collect()
            worst = found.where("toxic = 1").orderBy(F.col("decision").desc(), "unit").limit(WORDS).collect()
            # a sentence is toxic if few clean documents have one that looks as bad
            above, limit = 0, 0.0
            for r in clean:
                above += r["n"]
                if above > n0 * NOISE:
                    limit = max(r["decision"], 0.0)
                    break
            bad = {r["unit"]: r["decision"] for r in clean}
            known = set(pos)
            pos += [r["unit"] for r in worst if r["decision"] > limit and r["unit"] not in known and r["unit"] not in bad]
            at = {u: i for i, u in enumerate(others)}
            fresh = [u for u in bad if u not in at and u not in known]
            for u, value in bad.items():
                if u in at:
                    closeness[at[u]] = value
            others, closeness = others + fresh, np.concatenate([closeness, [bad[u] for u in fresh]])
        marks = best + [others[i] for i in np.argsort(-closeness, kind="stable")[: LANDMARKS // 2]]
        machine, closeness = trained(pos, others, marks)
    seen = decided(rows.select(F.lit(0).alias("doc_id"), "text", "y"), machine, keep=("y",)).select("y", "decision").toArrow()  # no more rows than were learned from
    work.drop(rows)
    slope, offset = platt(seen["decision"].to_numpy(), (seen["y"].to_numpy() > 0).astype(float))
    return Machine(machine.weights, machine.bias, slope, offset, landmarks=machine.landmarks)


def platt(d: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic function, with smoothed targets, by Newton steps."""
    order = np.argsort(d, kind="stable")
    d, t = d[order], t[order]
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    x, w = np.column_stack([d, np.ones(len(d))]), np.array([1.0, 0.0])
    for _ in range(60):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(2) * 1e-3
        w = w - 0.5 * np.linalg.solve(h, x.T @ (p - target))
    return max(float(w[0]), 0.1), float(w[1])


def decided(df: DataFrame, machine: Machine, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, decision and score of every row."""

    def run(batches):
        for b in batches:
            d = machine.decisions(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(d, pa.float64()), pa.array(machine.probability(d), pa.float64())], [*b.schema.names[:-1], "decision", "score"])

    rows = df.select(F.col(id).alias("doc_id"), *keep, F.col(text).cast("string").alias("_text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return arrow_map(rows, run, ", ".join([*kinds, "decision double", "score double"]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = decided(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
