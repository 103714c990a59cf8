"""Toxicity by a bidirectional gated recurrent network, trained and run in numpy.

A word enters as three vectors: an embedding of its hash, the average of the embeddings
of its character trigrams, so that spellings it has not seen still say something, and the
state in which a small gated recurrent network ends that reads its bytes one by one. A
network of gated recurrent units reads a window of words in both directions, an
attention layer pools the states, and a linear layer gives the window's logit. A
text's logit is the highest of all its overlapping windows, so that its length and
the place of an insult in it do not matter; two numbers fitted on labelled texts
turn it into a probability. Windows of `WIDTH` words begin every `STRIDE` words and one
ends with the text: every word is read, and each run of up to WIDTH - STRIDE + 1 words
lies whole in a window.

Only fitting uses a sample: about `max_labelled` labelled texts taken by hash, a class
that has fewer than half of them whole, of which the driver receives a few windows each
(a bound holds even where one id is on most rows). Word statistics of the sample (of
`MOST_WORDS` words at most) choose them: the most telling one of a toxic text, the most
telling and other ones of the rest. In a second round the network itself chooses, and
training goes on with those. The two numbers are fitted with weights that give
the classes their shares among all labels. Scoring covers every word of every text.

Edge cases: a null or empty text is one window without words, whose logit is the
output's constant; rows without a label are not learned from; with labels of one
class or none, or no text for one of them, every score is the share of toxic labels
(0 without labels); repeated rows score alike, of several labels of one id the largest
counts. A worker holds one chunk of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import bytes_list, documents, held_out, sub_batches, table
from coterie.llm.windows import word_hashes, word_places

WIDTH, STRIDE = 32, 16
WORDS, GRAMS, DIM, HIDDEN = 1 << 14, 1 << 13, 8, 8
#: Of the network over the bytes of a word: what a byte enters as, and its state.
BYTE, SPELL = 6, 8
INPUT = 2 * DIM + SPELL
MOST_WORDS = 200_000
CHUNK = 1 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Words:
    """The distinct words of some texts as inputs: word bucket, trigram buckets and where they begin, bytes."""

    def __init__(self, texts: list[bytes]):
        joined, lo, hi, self.sizes = word_places([t.lower() for t in texts])
        hashes = word_hashes(joined, lo, hi)[:, 0]
        self.hashes, at, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        lo, hi = lo[at], hi[at]
        room = hi - lo
        self.bucket = (self.hashes >> np.uint64(40)).astype(np.int64) % WORDS
        # trigrams around each byte of the word, with the white space before and after it
        padded = np.concatenate([[10], joined, [10]]).astype(np.uint64)
        code = padded[:-2] * np.uint64(65536) + padded[1:-1] * np.uint64(256) + padded[2:]
        blank = np.isin(padded, [32, 9, 11, 12, 13])
        if blank.any():
            padded[blank] = 10
            code = padded[:-2] * np.uint64(65536) + padded[1:-1] * np.uint64(256) + padded[2:]
        ends = np.cumsum(room)
        self.gram_at = ends - room
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - self.gram_at, room)
        self.grams = ((code[place] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % GRAMS
        self.gram_n = room
        self.joined, self.lo = joined, lo


def window_starts(sizes: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows: each text from its first word on by the stride, the last flush with its end."""
    count = 1 + np.maximum(0, -(-(sizes - width) // stride))
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(nth * stride, np.maximum(sizes[owner] - width, 0))
    return owner, first, np.minimum(sizes[owner], width)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        p = {"words": draw(WORDS, DIM, by=0.3), "grams": draw(GRAMS, DIM, by=0.3), "attend": draw(2 * HIDDEN, by=0.1), "out": draw(2 * HIDDEN, by=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            p |= {f"W{side}": draw(INPUT, 3 * HIDDEN, by=0.25), f"R{side}": draw(HIDDEN, 3 * HIDDEN, by=0.25), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"bytes": draw(256, BYTE, by=0.3), "Ws": draw(BYTE, 3 * SPELL, by=0.3), "Rs": draw(SPELL, 3 * SPELL, by=0.3), "cs": np.zeros(3 * SPELL, np.float32)}
        return Network(p)

    def inputs(self, w: Words) -> np.ndarray:
        if not len(w.bucket):
            return np.zeros((0, INPUT), np.float32)
        chars = np.add.reduceat(self.p["grams"][w.grams], w.gram_at, axis=0) / w.gram_n[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][w.bucket], chars, self.spelled(w.joined, w.lo, w.gram_n)], axis=1)

    def spelled(self, joined: np.ndarray, lo: np.ndarray, size: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The state after the last byte of each word joined[lo:lo + size]; longer words come first, so that those still read are a front part."""
        order = np.argsort(-size, kind="stable")
        at, R = lo[order], self.p["Rs"]
        h, table = np.zeros((len(lo), SPELL), self.p["Rs"].dtype), self.p["bytes"] @ self.p["Ws"] + self.p["cs"]
        reading = len(size) - np.cumsum(np.bincount(size)) if len(size) else np.zeros(0, int)  # words longer than t bytes
        for t, n in enumerate(reading[:-1].tolist()):
            byte, before = joined[at[:n] + t], h[:n]
            a, u = table[byte], before @ R
            zr = sigmoid(a[:, : 2 * SPELL] + u[:, : 2 * SPELL])
            z, r = zr[:, :SPELL], zr[:, SPELL:]
            m = np.tanh(a[:, 2 * SPELL :] + r * u[:, 2 * SPELL :])
            if keep is not None:
                keep.append((byte, before.copy(), z, r, m, u[:, 2 * SPELL :]))
            h[:n] = m + z * (before - m)
        out = np.empty_like(h)
        out[order] = h
        return out

    def spelling_gradients(self, size: np.ndarray, kept: list, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of the parameters over bytes, from the gradient by the states that spelled() returned."""
        order = np.argsort(-size, kind="stable")
        dh, R = d[order], self.p["Rs"]
        dR, dtable = np.zeros_like(R), np.zeros((256, 3 * SPELL), R.dtype)
        rows, values = [], []
        for byte, h, z, r, m, un in reversed(kept):
            n = len(byte)
            dnew = dh[:n]
            dm = dnew * (1 - z) * (1 - m * m)
            dz = dnew * (h - m) * z * (1 - z)
            dr = dm * un * r * (1 - r)
            from_h = np.concatenate([dz, dr, dm * r], axis=1)
            rows.append(byte)
            values.append(np.concatenate([dz, dr, dm], axis=1))
            dR += h.T @ from_h
            dh[:n] = dnew * z + from_h @ R.T
        if rows:
            _scatter(dtable, np.concatenate(rows), np.concatenate(values))
        return {"Rs": dR, "Ws": self.p["bytes"].T @ dtable, "cs": dtable.sum(axis=0), "bytes": dtable @ self.p["Ws"].T}

    def read(self, projected: np.ndarray, index: np.ndarray, lens: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (words of the window, windows, HIDDEN) in one direction; index: (windows, WIDTH)."""
        n, width = index.shape
        R, h = self.p[f"R{side}"], np.zeros((n, HIDDEN), np.float32)
        out = np.empty((width, n, HIDDEN), np.float32)
        whole = bool((lens == width).all())
        for t in range(width) if side == "f" else range(width - 1, -1, -1):
            a, u = projected[index[:, t]], h @ R
            zr = sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            m = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = m + z * (h - m)
            inside = None if whole else (t < lens)[:, None]
            if keep is not None:
                keep.append((t, h, z, r, m, u[:, 2 * HIDDEN :], inside))
            h = new if whole else np.where(inside, new, h)
            out[t] = h
        return out

    def pool(self, states: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(attention, pooled states, logits)."""
        e = states @ self.p["attend"]
        inside = np.arange(len(states))[:, None] < lens
        e = np.where(inside, e, -1e9)
        a = np.exp(e - e.max(axis=0)) * inside
        a = a / np.maximum(a.sum(axis=0), 1e-9)
        c = np.einsum("tn,tnh->nh", a, states)
        return a, c, c @ self.p["out"] + self.p["bias"][0]

    def window_logits(self, x: np.ndarray, index: np.ndarray, lens: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.read(x @ self.p[f"W{s}"] + self.p[f"c{s}"], index, lens, s) for s in "fb"], axis=2)
        return self.pool(states, lens)[2]

    def gradients(self, x: np.ndarray, index: np.ndarray, lens: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted cross-entropy: by parameter, and by input row."""
        g, kept, halves = {}, {}, []
        for s in "fb":
            kept[s] = []
            halves.append(self.read(x @ self.p[f"W{s}"] + self.p[f"c{s}"], index, lens, s, kept[s]))
        states = np.concatenate(halves, axis=2)
        a, c, logit = self.pool(states, lens)
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["bias"] = c.T @ d, np.array([d.sum()], np.float32)
        dc = d[:, None] * self.p["out"]
        da = np.einsum("tnh,nh->tn", states, dc)
        de = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", de, states)
        dstates = a[:, :, None] * dc[None] + de[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for k, s in enumerate("fb"):
            W, R = self.p[f"W{s}"], self.p[f"R{s}"]
            own = dstates[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dR, dproj, dh = np.zeros_like(R), np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros(own.shape[1:], np.float32)
            for t, h, z, r, m, un, inside in reversed(kept[s]):
                dh = dh + own[t]
                dnew = dh if inside is None else dh * inside
                past = 0 if inside is None else dh * ~inside
                dm = dnew * (1 - z) * (1 - m * m)
                dz = dnew * (h - m) * z * (1 - z)
                dr = dm * un * r * (1 - r)
                from_x = np.concatenate([dz, dr, dm], axis=1)
                from_h = np.concatenate([dz, dr, dm * r], axis=1)
                dR += h.T @ from_h
                np.add.at(dproj, index[:, t], from_x) if len(x) < 64 else _scatter(dproj, index[:, t], from_x)
                dh = dnew * z + past + from_h @ R.T
            g[f"R{s}"], g[f"W{s}"], g[f"c{s}"] = dR, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ W.T
        return g, dx

    def text_logits(self, texts: list[bytes]) -> np.ndarray:
        """The highest logit of each text's windows."""
        owner, logits = self.logits(Words(texts))
        return np.maximum.reduceat(logits, np.flatnonzero(np.diff(owner, prepend=-1))) if len(owner) else logits

    def logits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window, in the order of window_starts."""
        owner, first, lens = window_starts(w.sizes)
        begin = np.cumsum(w.sizes) - w.sizes
        x = np.concatenate([self.inputs(w), np.zeros((1, INPUT), np.float32)])  # the last row stands where a window has no word
        index = np.append(w.index, len(x) - 1)
        projected = {s: x @ self.p[f"W{s}"] + self.p[f"c{s}"] for s in "fb"}
        logits = np.empty(len(owner), np.float32)
        for at in range(0, len(owner), 4096):
            sl = slice(at, at + 4096)
            place = (begin[owner[sl]] + first[sl])[:, None] + np.arange(WIDTH)
            place = np.where(np.arange(WIDTH) < lens[sl][:, None], place, len(index) - 1)
            own = index[place]
            states = np.concatenate([self.read(projected[s], own, lens[sl], s) for s in "fb"], axis=2)
            logits[sl] = self.pool(states, lens[sl])[2]
        return owner, logits

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * logits.astype(np.float64) + self.shift)


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    cut = np.flatnonzero(np.diff(r, prepend=-1))
    into[r[cut]] += np.add.reduceat(values[order], cut, axis=0)


def train(windows: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 3, least_steps: int = 200, net: Network | None = None, hidden: float = 0.5) -> Network:
    """Adam on the windows' cross-entropy, the classes weighing the same; few windows are gone through more often. Goes on with net if it is given.

    hidden: the share of words that enter a step without the embedding of their hash, so that
    spellings are learned from and words of single texts are not learned by heart.
    """
    epochs = max(epochs, -(-least_steps * batch // max(len(windows), 1)))
    net, rng = net or Network.fresh(seed), np.random.default_rng(seed)
    w = Words(windows)
    begin = np.cumsum(w.sizes) - w.sizes
    lens = np.minimum(w.sizes, WIDTH)
    index = np.append(w.index, len(w.bucket))
    place = np.where(np.arange(WIDTH) < lens[:, None], begin[:, None] + np.arange(WIDTH), len(index) - 1)
    index = index[place]
    y = labels.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        now = rate * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            used, own = np.unique(index[rows], return_inverse=True)
            own = own.reshape(len(rows), WIDTH)
            real = used[used < len(w.bucket)]
            grams = np.concatenate([w.grams[w.gram_at[i] : w.gram_at[i] + w.gram_n[i]] for i in real.tolist()]) if len(real) else w.grams[:0]
            n = w.gram_n[real]
            starts = np.cumsum(n) - n
            x, spelling = np.zeros((len(used), INPUT), np.float32), []
            if len(real):
                seen = rng.random(len(real)) >= hidden
                x[: len(real), :DIM] = net.p["words"][w.bucket[real]] * seen[:, None]
                x[: len(real), DIM : 2 * DIM] = np.add.reduceat(net.p["grams"][grams], starts, axis=0) / n[:, None].astype(np.float32)
                x[: len(real), 2 * DIM :] = net.spelled(w.joined, w.lo[real], n, spelling)
            g, dx = net.gradients(x, own, lens[rows], y[rows], weight[rows])
            g |= net.spelling_gradients(n, spelling, dx[: len(real), 2 * DIM :])
            g["words"], g["grams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
            if len(real):
                _scatter(g["words"], w.bucket[real], dx[: len(real), :DIM] * seen[:, None])
                _scatter(g["grams"], grams, np.repeat(dx[: len(real), DIM : 2 * DIM] / n[:, None].astype(np.float32), n, axis=0))
            step += 1
            for k, v in net.p.items():
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] * g[k] - m2[k])
                v -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int = 200) -> None:
    """Fits scale and shift of the texts' logits, each text with its weight, with a small ridge.

    Newton steps on a convex loss, each halved until the loss falls: where the classes are
    far apart the loss is nearly flat, and whole steps would leave for good.
    """
    x = np.stack([logits.astype(np.float64), np.ones(len(logits))], axis=1)
    start, ridge = np.array([1.0, 0.0]), 1e-3

    def loss(b: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ b))).sum() + ridge / 2 * ((b - start) ** 2).sum())

    b, now = start.copy(), loss(start)
    for _ in range(steps):
        p = sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(h, x.T @ (weight * (labels - p)) - ridge * (b - start))
        while np.abs(move).max() > 1e-9 and not loss(b + move) < now:
            move = move / 2
        if np.abs(move).max() <= 1e-9:
            break
        b = b + move
        now = loss(b)
    net.scale, net.shift = max(float(b[0]), 1e-3), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, label: str = "toxic", windows_of_clean: int = 3, rounds: int = 2, seed: int = 3) -> Network | float:
    """The network, or the share of toxic labels where there is nothing to tell apart."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return float(counts.get(1, 0) / total) if total else 0.0
    rare = min(counts, key=lambda y: (counts[y], -y))
    take = {rare: min(counts[rare], max_labelled // 2)}
    take[1 - rare] = min(counts[1 - rare], max_labelled - take[rare])
    share = {y: int((1 << 20) * take[y] / counts[y]) for y in take}
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # about max_labelled ids of some bytes each; dealt by id, as many may share a text
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").repartition(parts, "doc_id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in sub_batches(batch, "text", CHUNK):
                w = Words(bytes_list(rows.column(0)))
                y = np.repeat(rows.column(1).to_numpy(), w.sizes)
                text = np.repeat(np.arange(rows.num_rows), w.sizes)
                _, once = np.unique(w.index * (rows.num_rows + 1) + text, return_index=True)
                both = [np.bincount(w.index[once][y[once] == v], minlength=len(w.hashes)).astype(np.int64) for v in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes.view(np.int64)), *map(pa.array, both)], ["word", "clean", "toxic"])

    # words of enough toxic texts, the most frequent ones
    told = sample.mapInArrow(count, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 2").orderBy(F.col("toxic").desc(), "word").limit(MOST_WORDS).toPandas()
    rate = take[1] / (take[0] + take[1])
    odds = np.log((told["toxic"] + 0.5) / (told["clean"] + 0.5) * (1 - rate) / rate)
    many = np.sqrt(told["toxic"])  # a word of few texts says less
    strong = odds > 1
    order = np.argsort(told["word"][strong].to_numpy())
    words, telling = told["word"][strong].to_numpy(np.int64)[order], (odds * np.minimum(many / 4, 1))[strong].to_numpy(float)[order]

    def chosen(net: Network | None) -> tuple[list[bytes], np.ndarray]:
        """Windows to learn from: the one of each text that is most telling by its words, or by the network so far, and others of clean texts."""
        sent = docs.sparkSession.sparkContext.broadcast((words, telling, net))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, telling, net = sent.value
            for batch in batches:
                for rows in sub_batches(batch, "text", CHUNK):
                    texts = bytes_list(rows.column(0))
                    out, ys = [], []
                    for text, y in zip(texts, rows.column(1).to_pylist()):
                        own, w = text.split(), Words([text])
                        _, first, lens = window_starts(w.sizes)
                        if net is not None:
                            score = net.logits(w)[1]
                        else:
                            found = np.minimum(np.searchsorted(words, w.hashes.view(np.int64)), max(len(words) - 1, 0))
                            value = np.where(words[found] == w.hashes.view(np.int64), telling[found], 0.0) if len(words) else np.zeros(len(w.hashes))
                            sums = np.concatenate([[0], np.cumsum(value[w.index])])
                            score = sums[first + lens] - sums[first]
                        best = int(score.argmax())
                        take = [best] if y else list(dict.fromkeys([best, *(int(i) for i in np.linspace(0, len(first) - 1, windows_of_clean).astype(int))]))
                        for i in take:
                            out.append(b" ".join(own[first[i] : first[i] + lens[i]]))
                            ys.append(y)
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ys, pa.int32())], ["window", "y"])

        # the limits only bind where some doc_id is on very many rows
        got = sample.mapInArrow(choose, "window binary, y int").limit(2 * max_labelled * (1 + windows_of_clean)).toPandas()
        got["window"] = got["window"].map(bytes)
        got = got.sort_values(["y", "window"], kind="stable")
        return got["window"].tolist(), got["y"].to_numpy()

    net = None
    for nth in range(rounds):
        windows, y = chosen(net)
        if len(set(y.tolist())) < 2:
            return float(counts[1] / total)
        net = train(windows, y, seed=seed + nth, net=net)
    scored = logits_of(sample, net).select("logit", "y").limit(2 * max_labelled).toPandas().sort_values(["y", "logit"], kind="stable")
    y = scored["y"].to_numpy()
    calibrate(net, scored["logit"].to_numpy(), y, np.where(y == 1, counts[1] / take[1], counts[0] / take[0]) * (take[0] + take[1]) / total)
    return net


def logits_of(docs: DataFrame, net: Network) -> DataFrame:
    """Adds the column logit; drops text."""
    kept = [c for c in docs.columns if c not in ("text", "logit")]
    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField("logit", T.DoubleType(), False)])
    sent = docs.sparkSession.sparkContext.broadcast(net)  # under 2 MB: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for rows in sub_batches(batch, "text", CHUNK):
                found = own.text_logits(bytes_list(rows.column(rows.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in kept), pa.array(found.astype(np.float64))], [*kept, "logit"])

    return docs.select(*kept, "text").mapInArrow(run, out)


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """Adds score and predicted; drops text."""
    if isinstance(net, float):
        out = docs.drop("text").withColumn("score", F.lit(net))
    else:
        out = logits_of(docs, net).withColumn("score", 1 / (1 + F.exp(-(F.lit(net.scale) * F.col("logit") + F.lit(net.shift))))).drop("logit")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out())
    net = fit(docs, labels)
    return score(docs, net).select("doc_id", "held_out", "score", "predicted")
