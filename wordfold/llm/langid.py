"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text in stretches of ``STEPS`` bytes, from both ends of each; at every byte the two hidden states
give a probability for each language, and the mean over all bytes of the text decides.  It is trained with numpy by
backpropagation through time on a bounded sample: at most ``PER_LANGUAGE`` different texts of each language, at most
``SAMPLE_CHARS`` characters of each, drawn by a hash.  Prediction reads every byte of every text.

Null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn from.
Rows with the same text get the same answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.llm import rows, sample

STEPS = 64
HIDDEN = 8
PER_LANGUAGE = 300
SAMPLE_CHARS = 2000
TRAIN_STEPS = 300
BATCH = 256
UNKNOWN = "und"
#: Stretches predicted at once; bounds the memory of a task whatever the length of a text.
_TOGETHER = 2048


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]  # f_in, f_rec, b_in, b_rec (update, reset, candidate), out_f, out_b, bias


def _initial(rng: np.random.Generator, languages: int) -> dict[str, np.ndarray]:
    h = HIDDEN
    out = {}
    for side in "fb":
        out[side + "_in"] = rng.normal(0, 0.3, (3, 256, h))
        out[side + "_rec"] = rng.normal(0, 1 / np.sqrt(h), (3, h, h))
        out["out_" + side] = rng.normal(0, 0.3, (languages, h))
    out["bias"] = np.zeros((languages, 1))
    return {k: v.astype(np.float32) for k, v in out.items()}


def _logistic(a: np.ndarray) -> None:
    a *= 0.5
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5


def _states(x: np.ndarray, w_in: np.ndarray, w_rec: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
    """Hidden states [steps, batch, hidden] of bytes [steps, batch]; ``keep`` collects what the gradient needs."""
    shape = (x.shape[1], HIDDEN)
    state = np.zeros(shape, np.float32)
    out = np.empty((x.shape[0], *shape), np.float32)
    z, r, c, rec = (np.empty(shape, np.float32) for _ in range(4))
    for t in order:
        at = x[t].astype(np.intp)
        for gate, k in ((z, 0), (r, 1)):
            np.take(w_in[k], at, axis=0, out=gate, mode="clip")
            gate += np.matmul(state, w_rec[k], out=rec)
            _logistic(gate)
        np.take(w_in[2], at, axis=0, out=c, mode="clip")
        np.matmul(state, w_rec[2], out=rec)
        if keep is not None:
            rec_c = rec.copy()
        rec *= r
        c += rec
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((state, z.copy(), r.copy(), c.copy(), rec_c))
        c -= state
        c *= z
        state = np.add(state, c, out=out[t])
    return out


def _probabilities(w: dict[str, np.ndarray], forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """[steps, languages, batch]"""
    score = np.matmul(w["out_f"], forward.transpose(0, 2, 1))
    score += np.matmul(w["out_b"], backward.transpose(0, 2, 1))
    score += w["bias"]
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=1, keepdims=True)
    return score


def _backward(x, w_in, w_rec, order, kept, d_out):
    """Gradients of the weights from those of the hidden states, back through time."""
    g_in, g_rec = np.zeros_like(w_in), np.zeros_like(w_rec)
    carry = np.zeros_like(d_out[0])
    for t, (before, z, r, cand, rec_c) in zip(reversed(order), reversed(kept), strict=True):
        d = d_out[t] + carry
        d_cand = d * z * (1 - cand * cand)
        gates = (d * (cand - before) * z * (1 - z), d_cand * rec_c * r * (1 - r), d_cand)
        seen = np.zeros((256, x.shape[1]), np.float32)
        seen[x[t], np.arange(x.shape[1])] = 1
        carry = d * (1 - z)
        for k, g in enumerate(gates):
            g_in[k] += seen @ g
            if k == 2:
                g = g * r
            g_rec[k] += before.T @ g
            carry += g @ w_rec[k].T
    return g_in, g_rec


def gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all labelled bytes and its gradient; x, mask: [steps, batch], label: [batch]."""
    steps = x.shape[0]
    kept_f, kept_b = [], []
    fw = _states(x, w["f_in"], w["f_rec"], range(steps), kept_f)
    bw = _states(x, w["b_in"], w["b_rec"], range(steps - 1, -1, -1), kept_b)
    p = _probabilities(w, fw, bw)
    at = (np.arange(steps)[:, None], label[None, :], np.arange(x.shape[1])[None, :])
    n = max(mask.sum(), 1)
    loss = float(-(np.log(p[at] + 1e-9) * mask).sum() / n)
    d = p.copy()
    d[at] -= 1
    d *= (mask / n)[:, None, :]
    g = {"bias": d.sum(axis=(0, 2))[:, None]}
    g["out_f"] = np.einsum("tlb,tbh->lh", d, fw, optimize=True)
    g["out_b"] = np.einsum("tlb,tbh->lh", d, bw, optimize=True)
    g["f_in"], g["f_rec"] = _backward(x, w["f_in"], w["f_rec"], range(steps), kept_f, np.matmul(d.transpose(0, 2, 1), w["out_f"]))
    g["b_in"], g["b_rec"] = _backward(x, w["b_in"], w["b_rec"], range(steps - 1, -1, -1), kept_b, np.matmul(d.transpose(0, 2, 1), w["out_b"]))
    return loss, g


def stretches(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of each stretch of at most ``STEPS`` bytes, and the text it belongs to."""
    size = np.diff(starts)
    parts = -(-size // STEPS)
    text = np.repeat(np.arange(len(size)), parts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[:-1][text] + within * STEPS
    return begin, np.minimum(STEPS, starts[1:][text] - begin), text


def _bytes_at(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [steps, batch] (0 after the end) and the mask of real ones."""
    step = np.arange(STEPS)[:, None]
    mask = step < length[None, :]
    return np.where(mask, data[np.minimum(begin[None, :] + step, len(data) - 1)], np.uint8(0)), mask


def train(sample: list[tuple[str, str]], steps: int = TRAIN_STEPS, seed: int = 7) -> Network | None:
    """A network from (text, language) pairs; None without any."""
    sample = [(t.encode(), lang) for t, lang in sample if t]
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    data = np.frombuffer(b"".join(t for t, _ in sample), np.uint8)
    starts = np.cumsum([0, *[len(t) for t, _ in sample]])
    begin, length, text = stretches(data, starts)
    of_text = np.array([languages.index(lang) for _, lang in sample])
    label = of_text[text]
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(label == k) for k in range(len(languages))]
    w = _initial(rng, len(languages))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_label[k]) for k in rng.integers(0, len(languages), BATCH)])
        x, mask = _bytes_at(data, begin[pick], length[pick])
        _, g = gradients(w, x, mask.astype(np.float32), label[pick])
        rate = 0.02 * min(1.0, step / 20) * (0.05 ** (step / steps))
        for k, v in g.items():  # Adam
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            w[k] = (w[k] - rate * move).astype(np.float32)
    return Network(languages, w)


def predict(net: Network, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean probability of each language over all bytes, [texts, languages]; rows of zeros for empty texts."""
    starts = np.asarray(starts, np.int64)
    begin, length, text = stretches(data, starts)
    total = np.zeros((len(starts) - 1, len(net.languages)))
    w = net.weights
    for at in range(0, len(begin), _TOGETHER):
        part = slice(at, at + _TOGETHER)
        x, mask = _bytes_at(data, begin[part], length[part])
        fw = _states(x, w["f_in"], w["f_rec"], range(STEPS))
        bw = _states(x, w["b_in"], w["b_rec"], range(STEPS - 1, -1, -1))
        p = _probabilities(w, fw, bw)
        p *= mask[:, None, :]
        sums = p.sum(axis=0)
        for k in range(len(net.languages)):
            total[:, k] += np.bincount(text[part], weights=sums[k], minlength=len(total))
    return total / np.maximum(np.diff(starts), 1)[:, None]


def sample_rows(labelled: DataFrame, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """The bounded training sample, the same on every run: the texts of each language with the smallest hashes."""
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    drawn = labelled.where(text.isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text, F.lit(11)).alias("h"), F.substring(text, start, F.lit(SAMPLE_CHARS)).alias("part")
    )
    found = sample.smallest_hashes(drawn, "lang", "h", F.col("part"), PER_LANGUAGE)
    return sorted((r["value"], r["lang"]) for r in found.select("value", "lang").collect())


def _predictor(net: Network | None):
    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(text: pa.Array) -> pa.Array:
        p = predict(net, *rows.buffer_of(text))
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array([net.languages[k] for k in best], pa.string()), pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))], ["lang", "score"]
        )

    return identify


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language and its probability; only the text is read."""
    if net is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    named = docs.withColumn("__found", _predictor(net)(F.col(text_col)))
    known = has_letter(text_col)
    return named.withColumns(
        {lang: F.when(known, F.col("__found.lang")).otherwise(UNKNOWN), score: F.when(known, F.col("__found.score")).otherwise(0.0)}
    ).drop("__found")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    return train(sample_rows(docs.where(~held_out(id_col)), text_col, lang_col))


#: A text is rejected if its best language has a lower probability.
LEAST_SCORE = 0.35


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the texts that have no letter or no language with a probability of ``LEAST_SCORE``."""
    net = fit(docs, id_col, text_col, lang_col)
    found = identify(rows.packed(docs, text_col), net, text_col, "__lang", "__score")
    return rows.unpacked(found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)))
