"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over embedded bytes of a fixed-length window; the
maximum of each over the window feeds a softmax. Training takes a bounded,
balanced sample of labelled windows; prediction covers whole texts in batches of
windows and averages the windows' probabilities by their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, filter widths (bytes), filters a width, size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
#: Bound of the training sample: documents in all, and windows taken of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 4
#: Labels that are learned at most.
MAX_LANGUAGES = 256
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 11
#: Windows that are computed at once.
CHUNK = 2048
#: Mean probability under which the pipeline rejects a document.
MIN_SCORE = 0.4
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width x EMBED x FILTERS, for each of WIDTHS
    bias: np.ndarray
    out: np.ndarray  # features x languages
    out_bias: np.ndarray


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = SEED) -> Model:
    """windows: n x WINDOW bytes; labels: index into languages. Cross entropy, Adam."""
    rng = np.random.default_rng(seed)
    k, feats = len(languages), FILTERS * len(WIDTHS)
    par = {
        "e": rng.normal(0, 0.3, (256, EMBED)),
        "b": np.zeros(feats),
        "o": rng.normal(0, 0.1, (feats, k)),
        "c": np.zeros(k),
    } | {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    par = {name: x.astype(np.float32) for name, x in par.items()}
    m1 = {name: np.zeros_like(x) for name, x in par.items()}
    m2 = {name: np.zeros_like(x) for name, x in par.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = windows[pick], labels[pick]
            n, rows = len(x), np.arange(len(x))[:, None]
            emb = par["e"][x]
            tops, args = [], []
            for w in WIDTHS:
                resp = sum(emb[:, j : WINDOW - w + 1 + j] @ par[f"w{w}"][j] for j in range(w))
                arg = resp.argmax(axis=1)
                args.append(arg)
                tops.append(np.take_along_axis(resp, arg[:, None], axis=1)[:, 0])
            pre = np.concatenate(tops, axis=1) + par["b"]
            hid = np.maximum(pre, 0)
            logits = hid @ par["o"] + par["c"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            grad = {"o": hid.T @ p, "c": p.sum(axis=0)}
            back = (p @ par["o"].T) * (pre > 0)
            grad["b"] = back.sum(axis=0)
            ge = np.zeros_like(par["e"])
            for i, w in enumerate(WIDTHS):
                d, arg = back[:, i * FILTERS : (i + 1) * FILTERS], args[i]
                gw = np.empty_like(par[f"w{w}"])
                for j in range(w):  # only the byte windows that won the pooling
                    byte = x[rows, arg + j]
                    gw[j] = np.einsum("nfe,nf->ef", par["e"][byte], d)
                    np.add.at(ge, byte, d[:, :, None] * par[f"w{w}"][j].T[None])
                grad[f"w{w}"] = gw
            grad["e"] = ge
            step += 1
            for name, g in grad.items():
                m1[name] += 0.1 * (g - m1[name])
                m2[name] += 0.001 * (g * g - m2[name])
                par[name] -= RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, par["e"], [par[f"w{w}"] for w in WIDTHS], par["b"], par["o"], par["c"])


class Network:
    """A model compiled for prediction: the response of a filter to two adjacent
    bytes is looked up in a table."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = []
        for w, filters in zip(WIDTHS, model.filters, strict=True):
            one = [model.embed @ filters[j] for j in range(w)]
            mine = []
            for j in range(0, w, 2):
                if j + 1 < w:  # index: first byte + 256 x second
                    mine.append((j, True, (one[j][None, :, :] + one[j + 1][:, None, :]).reshape(65536, -1)))
                else:
                    mine.append((j, False, one[j]))
            self.tables.append((w, mine))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        single = windows.astype(np.intp)
        pairs = single[:, :-1] | single[:, 1:] << 8
        tops = []
        for w, tables in self.tables:
            n, resp = WINDOW - w + 1, None
            for j, double, table in tables:
                got = table[(pairs if double else single)[:, j : j + n]]
                resp = got if resp is None else np.add(resp, got, out=resp)
            tops.append(resp.max(axis=1))
        hid = np.maximum(np.concatenate(tops, axis=1) + self.model.bias, 0)
        logits = hid @ self.model.out + self.model.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def documents(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text; offsets of len + 1 into the bytes."""
        size = np.diff(offsets)
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), count)
        no = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][doc] + no * WINDOW
        held = np.minimum(offsets[1:][doc] - start, WINDOW)
        out = np.zeros((len(size), len(self.model.languages)))
        for a in range(0, len(doc), CHUNK):
            s, h = start[a : a + CHUNK, None], held[a : a + CHUNK, None]
            at = np.arange(WINDOW)[None, :]
            x = np.where(at < h, data[np.minimum(s + at, len(data) - 1)], 0)
            np.add.at(out, doc[a : a + CHUNK], self.probabilities(x) * h)
        return out / np.maximum(size, 1)[:, None]


def to_window(text: bytes) -> np.ndarray:
    return np.frombuffer(text[:WINDOW].ljust(WINDOW, b"\0"), dtype=np.uint8)


def held_out(ident: Column) -> Column:
    """Rows that training must not see; false for a null ident."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Training windows: of about bound labelled documents in all, as many of each
    language as there are, up to its even share; picked by a hash of ident and
    text, equal rows once. Of more than MAX_LANGUAGES labels the most frequent are
    learned. Windows start at hashed places; one in four is cut short, so that
    short texts are known."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(ident)) & F.col(text).rlike(r"\p{L}"))
    often = rows.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(MAX_LANGUAGES)
    counts = {r[lang]: r["n"] for r in often.collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = max(1, bound // len(languages))
    row = F.xxhash64(F.col(ident), F.col(text), F.lit(SEED))
    draw = F.pmod(row, F.lit(1 << 20)) / float(1 << 20)
    part = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, share / counts[k]))])
    picked = rows.where(draw < part[F.col(lang)]).withColumn("__row", row)
    room = F.greatest(F.length(text) - WINDOW + 1, F.lit(1))
    places = [F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(ident), F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    rng = np.random.default_rng(SEED)
    windows, labels = [], []
    for r in sorted(picked.groupBy(lang, "__row").agg(F.first(F.array(*places)).alias("w")).collect(), key=lambda r: (r[lang], r["w"])):
        for i, w in enumerate(r["w"]):
            data = w.encode()
            windows.append(to_window(data[: rng.integers(12, WINDOW)] if i == 0 else data))
            labels.append(languages.index(r[lang]))
    return np.stack(windows), np.array(labels), languages


def fit(docs: DataFrame, **columns) -> Model | None:
    """A model of the labelled, not held-out documents; None if there are none (an empty table, say).

    Null texts and labels, and texts without a letter, teach nothing. Columns other than ident, text and lang
    are not read."""
    windows, labels, languages = sample(docs, **columns)
    return train(windows, labels, languages) if languages else None


def predict(text: Column, model: Model | None) -> Column:
    """struct(lang, score) of whole texts. 'und' with score 0 where the text is null
    or has no letter, or nothing was learned; else a learned language and its
    mean probability over the text's windows; equal texts get equal results."""
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return none
    network: list[Network] = []

    def run(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not network:
            network.append(Network(model))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"\0", dtype=np.uint8)
        p = network[0].documents(offsets, data)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        names = pa.array([model.languages[i] for i in best], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(np.minimum(p[np.arange(len(p)), best], 1.0))], names=["lang", "score"])

    got = F.arrow_udf(run, "lang string, score double")(F.coalesce(text, F.lit("")))
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), got).otherwise(none)
