"""A small convolutional text classifier, trained where the labelled documents lie and run where the documents lie."""
from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.llm.common import byte_sums, in_fold, renamed, string_bytes
from alarmspan.session import cut_lineage

BUCKETS = 1 << 15
PAD = 0
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&$|~`-_=+/\\"
# Bounds of ``training_sample``, and what a shard of the training rows holds on average.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 16_000_000
# Passes over all training rows; the shards' nets meet after each.
ROUNDS = 3
# Pieces in which the net's numbers meet, and intervals of the logits in which labels are counted for the cuts.
PIECES, INTERVALS = 256, 1 << 14
WIDTHS, FILTERS, DEPTH = (1, 2, 3), 8, 16
# Places scored at once: bounds the memory of a very long text.
STRETCH = 1 << 16
# Fewer labels of either kind in a language, and its threshold is the one for all.
LEAST_LABELS = 10


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts as rows of hashed features, each word's place in that table, and words per text.

    A word counts as itself and by its first 3 to 6 bytes, so that inflected and compounded forms share a part.  A text
    without words is one padding word, the table's last.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), "")))
    coded = lists.values.dictionary_encode()
    features = _features(pc.utf8_trim(coded.dictionary, characters=PUNCTUATION))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    word = ~np.append(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False), False)[codes]
    codes, owner = codes[word], owner[word]
    sizes = np.bincount(owner, minlength=len(texts))
    empty = np.flatnonzero(sizes == 0)
    codes = np.insert(codes, np.searchsorted(owner, empty), len(features) - 1)
    return features, codes, np.maximum(sizes, 1)


def _features(words: pa.Array) -> np.ndarray:
    """Five buckets per word, from multiplied bytes; a row of padding at the end."""
    out = np.full((len(words) + 1, 5), PAD, dtype=np.int32)
    offsets, data = string_bytes(words)
    size, sums = np.diff(offsets), byte_sums(offsets, data)
    for k, length in enumerate((None, 3, 4, 5, 6)):
        ends = offsets[1:] if length is None else offsets[:-1] + np.minimum(size, length)
        mixed = (sums[ends] - sums[offsets[:-1]] + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
        out[:-1, k] = (mixed >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return out


BLOCKS = [(w, j) for w in WIDTHS for j in range(w)]
REACH = max(WIDTHS) - 1


@dataclass
class TextNet:
    """Embeddings (a word's mean over its features), filters of several widths, maximum over the text, a linear score.

    ``filters[:, k]`` holds one position of one filter width (``BLOCKS``): a filter's response at a place is the sum, over
    its positions, of what the words there give, so each distinct word meets the filters once.
    """
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int, evidence: np.ndarray) -> "TextNet":
        """Random, but that one coordinate of the embedding starts as each feature's evidence, and one filter of each width
        looks at it: the maximum over a text gives no gradient to words that do not stand out yet."""
        rng = np.random.default_rng(seed)
        scale = np.array([0.3 * (w * DEPTH) ** -0.5 for w, _ in BLOCKS])
        net = TextNet(rng.normal(0, 0.3, (BUCKETS, DEPTH)).astype(np.float32),
                      (rng.normal(0, 1, (DEPTH, len(BLOCKS), FILTERS)) * scale[:, None]).astype(np.float32),
                      np.zeros(len(WIDTHS) * FILTERS, np.float32),
                      rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32))
        net.embedding[:, 0] = evidence
        net.filters[:, :, 0] = 0
        for k, (w, _) in enumerate(BLOCKS):
            net.filters[0, k, 0] = 1 / w
        net.weight[[i * FILTERS for i in range(len(WIDTHS))]] = 0.2
        return net

    def given(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of distinct words, and what each gives to every filter position; the last word is padding and gives 0."""
        words = self.embedding[features].mean(axis=1)
        words[-1] = 0
        gives = (words @ self.filters.reshape(DEPTH, -1)).reshape(len(words), len(BLOCKS), FILTERS)
        return words, gives

    def responses(self, gives: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Responses at all places of ``line`` but the last ``REACH``."""
        n = len(line) - REACH
        out = []
        for w in WIDTHS:
            total = gives[line[:n], BLOCKS.index((w, 0))]
            for j in range(1, w):
                total = total + gives[line[j:n + j], BLOCKS.index((w, j))]
            out.append(total)
        return np.concatenate(out, axis=1) + self.bias

    def pooled(self, gives: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Largest response of every filter in every text; stretch by stretch, so a long text needs no more memory."""
        line, starts = laid_out(codes, sizes, len(gives) - 1)
        best = np.full((len(sizes), len(self.bias)), -np.inf, np.float32)
        for a in range(0, starts[-1], STRETCH):
            b = min(starts[-1], a + STRETCH)
            out = self.responses(gives, line[a:b + REACH])
            first, last = np.searchsorted(starts, [a, b - 1], side="right") - 1
            cuts = np.maximum(starts[first:last + 1], a) - a
            best[first:last + 1] = np.maximum(best[first:last + 1], np.maximum.reduceat(out, cuts, axis=0))
        return best

    def tops(self, gives: np.ndarray, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``line`` each text's largest response of every filter stands (the first, on a tie), and that response."""
        if starts[-1] <= STRETCH:
            out = self.responses(gives, line)
            place = np.stack([a + out[a:b].argmax(0) for a, b in zip(starts, starts[1:])])
            return place, np.take_along_axis(out, place, axis=0)
        place = np.zeros((len(starts) - 1, len(self.bias)), np.int64)
        top = np.full(place.shape, -np.inf, np.float32)
        for text, (start, end) in enumerate(zip(starts, starts[1:])):
            for a in range(start, end, STRETCH):
                out = self.responses(gives, line[a:min(end, a + STRETCH) + REACH])
                at = out.argmax(0)
                found = np.take_along_axis(out, at[None], axis=0)[0]
                larger = found > top[text]
                place[text, larger], top[text, larger] = a + at[larger], found[larger]
        return place, top

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        features, codes, sizes = word_ids(texts)
        return np.maximum(self.pooled(self.given(features)[1], codes, sizes), 0) @ self.weight + self.offset

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts).astype(np.float64), -30, 30)))


def laid_out(codes: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with padding between, so that no filter spans two; where each starts, and the end."""
    starts = np.concatenate([[0], np.cumsum(sizes + REACH)])
    line = np.full(starts[-1] + REACH, pad)
    line[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * REACH, sizes)] = codes
    return line, starts


def evidence_counts(features: np.ndarray, codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per feature, the documents that have it and the sum of their labels (labels first)."""
    words = len(features)
    doc, word = np.divmod(np.unique(np.repeat(np.arange(len(sizes)), sizes) * words + codes), words)
    ones, both = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for column in features.T:  # one at a time: a fifth of the memory
        pairs = np.unique(doc * BUCKETS + column[word])
        ones += np.bincount(pairs % BUCKETS, labels[pairs // BUCKETS], BUCKETS)
        both += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    return ones, both


def log_odds(ones: np.ndarray, both: np.ndarray, rate: float) -> np.ndarray:
    """How far the documents that have a feature raise the log odds of the label above the base rate (shrunk by four
    documents at that rate)."""
    share = (ones + 4 * rate) / (both + 4)
    return np.log(share / (1 - share)) - np.log(rate / (1 - rate))


class Training:
    """A net with the squared gradients that Adagrad has seen; all its numbers lie in one vector, so that shards can meet."""
    names = ("embedding", "filters", "bias", "weight")

    def __init__(self, net: TextNet):
        self.net, self.seen = net, {k: np.full_like(getattr(net, k), 1e-2) for k in self.names}
        self.seen_offset = 1e-2

    def vector(self) -> np.ndarray:
        parts = [getattr(self.net, k).ravel() for k in self.names] + [self.seen[k].ravel() for k in self.names]
        return np.concatenate([*parts, [self.net.offset, self.seen_offset]]).astype(np.float64)

    def assign(self, vector: np.ndarray) -> "Training":
        at = 0
        for into in ([getattr(self.net, k) for k in self.names] + [self.seen[k] for k in self.names]):
            into[...] = vector[at:at + into.size].reshape(into.shape)
            at += into.size
        self.net.offset, self.seen_offset = float(vector[-2]), float(vector[-1])
        return self

    def learn(self, table: np.ndarray, all_codes: np.ndarray, all_sizes: np.ndarray, labels: np.ndarray, share: float,
              rng: np.random.Generator, batch: int = 32, rate: float = 0.05) -> None:
        """One pass of Adagrad on the log loss over some texts; classes weighed alike by the label's ``share`` in all of them."""
        net, ends = self.net, np.cumsum(all_sizes)
        balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        for chosen in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            sizes = all_sizes[chosen]
            own, codes = np.unique(np.concatenate([all_codes[ends[i] - all_sizes[i]:ends[i]] for i in chosen]), return_inverse=True)
            features = np.concatenate([table[own], table[-1:]])
            words, gives = net.given(features)
            line, starts = laid_out(codes, sizes, len(words) - 1)
            place, top = net.tops(gives, line, starts)
            hidden = np.maximum(top, 0)
            logit = hidden @ net.weight + net.offset
            slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]) * balance[chosen] / len(chosen)).astype(np.float32)
            at_top = slope[:, None] * net.weight * (top > 0)
            grads = {"weight": slope @ hidden, "bias": at_top.sum(0), "filters": np.zeros_like(net.filters)}
            word_grad = np.zeros_like(words)
            for k, (w, j) in enumerate(BLOCKS):
                mine = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
                there, g = line[place[:, mine] + j], at_top[:, mine]
                grads["filters"][:, k] = np.einsum("nfd,nf->df", words[there], g)
                np.add.at(word_grad, there, g[:, :, None] * net.filters[:, k].T)
            for key, g in grads.items():
                self.seen[key] += g * g
                getattr(net, key).__isub__(rate * g / np.sqrt(self.seen[key]))
            touched = np.flatnonzero(np.abs(word_grad).any(1))
            rows, g = features[touched].ravel(), np.repeat(word_grad[touched] / features.shape[1], features.shape[1], axis=0)
            distinct, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(distinct), DEPTH), np.float32)
            np.add.at(total, where, g)
            self.seen["embedding"][distinct] += total * total
            net.embedding[distinct] -= rate * total / np.sqrt(self.seen["embedding"][distinct])
            self.seen_offset += float(slope.sum()) ** 2
            net.offset -= rate * float(slope.sum()) / self.seen_offset ** 0.5


def train(texts: list[str | None], labels: np.ndarray, langs: list[str | None], seed: int = 7, epochs: int = 3,
          batch: int = 32, rate: float = 0.05) -> TextNet:
    """Fit on four fifths by Adagrad on the log loss (classes weighed alike); scale scores and set thresholds on the rest."""
    labels = np.asarray(labels, dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        net = TextNet.fresh(seed, np.zeros(BUCKETS))
        net.weight[:] = 0
        net.offset = 5.0 if len(labels) and labels[0] else -5.0
        return net
    kept = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    if len(set(labels[~kept].tolist())) < 2:
        kept[:] = False
    fit, rng = np.flatnonzero(~kept), np.random.default_rng(seed)
    table, codes, sizes = word_ids([texts[i] for i in fit])
    share = float(labels[fit].mean())
    net = TextNet.fresh(seed, log_odds(*evidence_counts(table, codes, sizes, labels[fit]), share))
    state = Training(net)
    for _ in range(epochs):
        state.learn(table, codes, sizes, labels[fit], share, rng, batch, rate)
    check = np.flatnonzero(kept) if kept.any() and 0 < labels[kept].sum() < kept.sum() else fit
    calibrate(net, [texts[i] for i in check], labels[check], [langs[i] for i in check])
    return net


def calibrate(net: TextNet, texts: list[str | None], labels: np.ndarray, langs: list[str | None]) -> None:
    """Shift logits so that 0.5 parts the kinds best; then per language, with labels enough, the score that does there."""
    logits = net.logits(texts)
    net.offset -= best_cut(logits, labels)
    spread = float(np.std(logits)) or 1.0
    net.slope = 4.0 / spread
    scores = net.scores(texts)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= LEAST_LABELS:
            net.thresholds[lang] = best_cut(scores[own], labels[own])


def best_cut(values: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors, the highest of them: where labels do not tell the kinds apart, nothing is above it."""
    order = np.argsort(values)
    v, y = values[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y)])
    raised = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    errors = missed + raised
    i = len(v) - int(np.argmin(errors[::-1]))
    if i == len(v):
        return float(v[-1] + (np.std(v) or 1.0))
    return float((v[i - 1] + v[i]) / 2) if i else float(v[0] - (np.std(v) or 1.0))


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, label: str, sample_docs: int = SAMPLE_DOCS,
                    sample_chars: int = SAMPLE_CHARS, longest: int = SAMPLE_CHARS // 100) -> DataFrame:
    """At most ``sample_docs`` labelled texts outside the held-out fold, in the order of a hash of their ids, together at most
    ``sample_chars`` characters; texts above ``longest`` characters are not learnt from, so that none takes the place of many.

    Rows are chosen by id and text, lengths only; then the chosen ones are read.  Rows that repeat are one, and an id with
    several texts counts each, so the bounds hold whatever comes again.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(label).alias("_label"))
    row = F.xxhash64(text)
    sized = docs.where(~in_fold(doc_id)).select(F.col(doc_id).alias("_id"), row.alias("_row"), F.coalesce(F.char_length(text), F.lit(0)).alias("_size"))
    order = [F.xxhash64(F.lit("sample"), "_id"), F.col("_id"), F.col("_row")]
    few = sized.where(F.col("_size") <= longest).join(known, "_id").dropDuplicates(["_id", "_row"]).orderBy(*order).limit(sample_docs)
    running = F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = few.withColumn("_run", running).where(F.col("_run") <= sample_chars).select("_id", "_row", "_label")
    chosen = cut_lineage(chosen, "toxicity-sample")
    # sample_docs rows at most: small whatever the tables' size.
    met = docs.join(F.broadcast(chosen), (docs[doc_id] == chosen["_id"]) & (row == chosen["_row"]))
    return met.select(F.col("_id"), F.col("_row"), docs[text].alias("text"), docs[lang].alias("lang"), F.col("_label").alias("label")) \
              .dropDuplicates(["_id", "_row"]).drop("_row")


def labelled_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, label: str) -> DataFrame:
    """Every labelled text outside the held-out fold, whole: (text, lang, label, kept, shard), a shard's rows together and in
    the order of a hash, so that what is learnt does not hang on how the tables are stored.

    Rows that repeat are one; an id with several texts counts each.  ``kept`` marks a fifth, on which cuts are set.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(label).cast("double").alias("label"))
    known = cut_lineage(known, "toxicity-labels")
    rows = docs.where(~in_fold(doc_id) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = rows.select("_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("_size")).join(known, "_id")
    count, chars = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    shards = max(1, -(-count // SAMPLE_DOCS), -(-chars // SAMPLE_CHARS))
    mixed = lambda what, *of: F.xxhash64(F.lit(what), *of)
    # Labels go to the shards of their ids and meet the texts there: a text crosses one exchange, however many labels there are.
    dealt = rows.withColumn("label", F.lit(None).cast("double")).unionByName(known, allowMissingColumns=True) \
                .withColumn("shard", F.pmod(mixed("shard", "_id"), F.lit(shards)).cast("int"))
    # More partitions than shards, so that few shards share one.
    met = dealt.repartition(int(min(4 * shards, 4096)), "shard") \
               .withColumn("label", F.max("label").over(Window.partitionBy("shard", "_id")))
    one = met.where("_row IS NOT NULL AND label IS NOT NULL").dropDuplicates(["shard", "_id", "_row"])
    kept = F.lit(count >= 50) & (F.pmod(mixed("kept", "_id", "_row"), F.lit(5)) == 4)
    return one.withColumns({"kept": kept, "_order": mixed("order", "_id", "_row")}).sortWithinPartitions("shard", "_order", "_id", "_row") \
              .select("text", "lang", "label", "kept", "shard")


def by_chars(frames: Iterator[pd.DataFrame], most: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """Frames cut so that their texts stay near ``most`` characters; a longer text comes alone."""
    for pdf in frames:
        upto = np.cumsum([len(t or "") for t in pdf["text"]])
        for _, part in pdf.groupby(upto // most, sort=True):
            yield part


def count_evidence(rows: DataFrame, share: float) -> np.ndarray:
    """``log_odds`` of every feature over all ``rows`` (text, label): sums per task, then per feature."""
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones, both = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for pdf in by_chars(frames):
            some, all_ = evidence_counts(*word_ids(pdf["text"].tolist()), pdf["label"].to_numpy())
            ones, both = ones + some, both + all_
        at = np.flatnonzero(both)
        yield pd.DataFrame({"bucket": at, "ones": ones[at], "both": both[at]})
    sums = rows.select("text", "label").mapInPandas(counted, "bucket long, ones double, both double") \
               .groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("both").alias("both")).toPandas()
    ones, both = np.zeros(BUCKETS), np.zeros(BUCKETS)
    ones[sums["bucket"]], both[sums["bucket"]] = sums["ones"], sums["both"]
    return log_odds(ones, both, share)


def one_round(rows: DataFrame, state: Training, share: float, seed: int) -> np.ndarray:
    """The state's numbers after a pass over all ``rows`` (text, label, shard, in the order of shards).

    Each shard learns from the same state by itself.  A number moves by the mean move of the shards that moved it: a rare
    word's embedding is not held back by the shards that do not have the word.
    """
    def learnt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finished(parts: list[pd.DataFrame]) -> pd.DataFrame:
            shard = int(parts[0]["shard"].iloc[0])
            texts = [t for p in parts for t in p["text"]]
            labels = np.concatenate([p["label"].to_numpy(np.float32) for p in parts])
            own = copy.deepcopy(state)
            before = own.vector()
            own.learn(*word_ids(texts), labels, share, np.random.default_rng((seed, shard)))
            moved = np.array_split(own.vector() - before, PIECES)
            return pd.DataFrame({"shard": shard, "piece": range(PIECES), "moved": [m.astype(np.float32).tobytes() for m in moved]})
        # A shard that holds far more than the average, as of an id with very many texts, is learnt from in parts.
        held: list[pd.DataFrame] = []
        count = chars = 0
        for pdf in by_chars(frames):
            for shard, part in pdf.groupby("shard", sort=False):
                if held and (held[0]["shard"].iloc[0] != shard or count > 2 * SAMPLE_DOCS or chars > 2 * SAMPLE_CHARS):
                    yield finished(held)
                    held, count, chars = [], 0, 0
                held.append(part)
                count, chars = count + len(part), chars + sum(len(t or "") for t in part["text"])
        if held:
            yield finished(held)

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        total = count = 0.0
        for body in pdf.sort_values(["shard", "moved"])["moved"]:
            move = np.frombuffer(body, np.float32).astype(np.float64)
            total, count = total + move, count + (move != 0)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "moved": [(total / np.maximum(count, 1)).tobytes()]})

    moves = rows.select("text", "label", "shard").mapInPandas(learnt, "shard int, piece int, moved binary")
    pieces = moves.groupBy("piece").applyInPandas(met, "piece int, moved binary").collect()
    return state.vector() + np.concatenate([np.frombuffer(r["moved"]) for r in sorted(pieces, key=lambda r: r["piece"])])


def set_cuts(rows: DataFrame, net: TextNet) -> None:
    """``calibrate`` over all ``rows`` (text, lang, label): labels are counted in ``INTERVALS`` of the logits, with the least
    and the largest logit of each, so only counts reach the driver."""
    def given(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_chars(frames):
            yield pd.DataFrame({"lang": pdf["lang"], "label": pdf["label"], "logit": net.logits(pdf["text"].tolist()).astype(np.float64)})
    logits = cut_lineage(rows.select("text", "lang", "label").mapInPandas(given, "lang string, label double, logit double"), "toxicity-logits")
    low, high, spread = logits.agg(F.min("logit"), F.max("logit"), F.stddev_pop("logit")).first()
    interval = F.least(F.floor((F.col("logit") - low) * (INTERVALS / max(high - low, 1e-30))), F.lit(INTERVALS - 1))
    counts = [F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.min("logit").alias("low"), F.max("logit").alias("high"),
              F.sum("logit").alias("sum"), F.sum(F.col("logit") * F.col("logit")).alias("squares")]
    net.slope = 4.0 / (spread or 1.0)
    cut = interval_cut(logits.groupBy(interval.alias("at")).agg(*counts).toPandas())
    net.offset -= cut
    enough = logits.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_ones")).where(
        F.col("lang").isNotNull() & (F.least("_ones", F.col("_n") - F.col("_ones")) >= LEAST_LABELS)).select("lang")
    by_lang = logits.join(enough, "lang").groupBy("lang", interval.alias("at")).agg(*counts).toPandas()
    for lang, part in by_lang.groupby("lang"):
        own = net.slope * (interval_cut(part) - cut)
        net.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(own, -30, 30))))


def interval_cut(counts: pd.DataFrame) -> float:
    """``best_cut`` between intervals: the cut with the fewest errors, the highest of them."""
    counts = counts.sort_values("at")
    n, ones, low, high = (counts[c].to_numpy(float) for c in ("n", "ones", "low", "high"))
    errors = np.concatenate([[0], np.cumsum(ones)]) + (n - ones).sum() - np.concatenate([[0], np.cumsum(n - ones)])
    beyond = max(0.0, counts["squares"].sum() / n.sum() - (counts["sum"].sum() / n.sum()) ** 2) ** 0.5 or 1.0
    i = len(n) - int(np.argmin(errors[::-1]))
    if i == len(n):
        return float(high[-1] + beyond)
    return float((high[i - 1] + low[i]) / 2) if i else float(low[0] - beyond)


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           label: str = "toxic", seed: int = 7, **bounds: int) -> TextNet:
    """The net, trained on every labelled text outside the held-out fold, in shards whose nets meet after each of ``ROUNDS``
    passes; evidence is counted and cuts are set over all of them as well.  Only the net and counts reach the driver.

    With ``bounds`` (sample_docs, sample_chars, longest) it is trained on ``training_sample`` within them instead.
    """
    if bounds:
        rows = training_sample(docs, labels, doc_id, text, lang, label, **bounds).collect()
        rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["text"] or ""))
        return train([r["text"] for r in rows], np.array([r["label"] for r in rows]), [r["lang"] for r in rows], seed)
    rows = cut_lineage(labelled_rows(docs, labels, doc_id, text, lang, label), "toxicity-rows")
    seen = {(r["kept"], r["label"]): r["count"] for r in rows.groupBy("kept", "label").count().collect()}
    both = lambda kept: len({y for k, y in seen if k in kept}) > 1
    if not both((True, False)):
        return train([], np.array(sorted({y for _, y in seen})), [])
    fit = rows.where("not kept") if both((False,)) else rows
    fitted = {k: n for k, n in seen.items() if not both((False,)) or not k[0]}
    share = sum(y * n for (_, y), n in fitted.items()) / sum(fitted.values())
    state = Training(TextNet.fresh(seed, count_evidence(fit, share)))
    for i in range(ROUNDS):
        state.assign(one_round(fit, state, share, seed + i))
    set_cuts(rows.where("kept") if both((True,)) and both((False,)) else fit, state.net)
    return state.net


def score_documents(docs: DataFrame, net: TextNet, text: str = "text", lang: str = "lang", batch_chars: int = 1 << 22) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; from the text alone) and ``toxic`` (score at or above its language's threshold, 0.5
    where there is none), under free names (``added_columns``).

    Null and empty texts get the score of a padding word; a null language has the common threshold; repeated rows are
    scored each; an empty table gives no rows.
    """
    score, toxic = added_columns(docs)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, held, part = [], 0, []
            for t in [*texts, None]:
                part.append(t)
                held += len(t or "")
                if held >= batch_chars:
                    out.append(net.scores(part))
                    held, part = 0, []
            if part:
                out.append(net.scores(part))
            yield pd.Series(np.concatenate(out)[:len(texts)])

    out = docs.withColumn(score, scored(F.col(text)))
    threshold = F.lit(0.5)
    for name, value in net.thresholds.items():
        threshold = F.when(F.col(lang) == name, F.lit(value)).otherwise(threshold)
    return out.withColumn(toxic, F.col(score) >= threshold)


def added_columns(docs: DataFrame) -> list[str]:
    return renamed(docs, "score", "toxic")
