"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. Letter trigrams are counted over every document (the counts grow with the corpus, their number is bounded by CLASSES**3)
   and make a character language model. Letters of other scripts share classes by a hash.
2. Text is lower-cased and folded (compatibility forms, invisible characters and stray combining marks). A token is then a lattice of
   characters: a look-alike (``1d10t``, Cyrillic or Greek letters, accents) may stand for its letters, a repeat (``idiooot``) for one or
   two, any other sign (``i.d.i.o.t``, ``i/d/i/o/t``) for nothing or a word boundary. Viterbi decoding takes the path of the highest model
   probability less the channel's costs. A run of three or more single characters (``i d i o t``) is read as one word and with word
   boundaries in the lattice, and its substrings are held against the lexicon.
3. A token of letters alone is decoded only if its skeleton (no accents, no repeats, look-alikes replaced) is that of an entry of the
   lexicon, for no other reading could change the score. Neighbouring tokens that make an entry together (``tra sh``) are one word
   if the model finds that likelier than the space.
4. The features of a restored text are its words and their first 4 to 6 letters (stems inflect). For each feature the toxic and
   other documents that have it are counted over the labelled rows one may learn from; features that a G test finds
   toxic beyond chance make the lexicon, the LEXICON strongest of them.
5. A logistic model of four numbers (strongest weight, log of the sum, log of the count, share of words) gives the score.

Labels are learnt from at most MAX_LABELLED rows (the smallest hashes of the id), never from rows whose crc32(id) mod 3 is 1.
Labels, language, source and id are no inputs of a score. Null and empty texts have no features and get the score of such texts;
if there is nothing to learn from, scores are 0.05. Repeated rows score alike; extra columns are kept by ``toxicity``'s caller.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, slices, small, small_batches, table

MAX_LABELLED = 100_000
MAX_FITTED = 20_000
LEXICON = 5_000
INPUTS = ["mq_x0", "mq_x1", "mq_x2", "mq_x3"]
THRESHOLD = 0.7
CLASSES = 128
BLOCK = 500_000
CACHED = 40_000
#: What a look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
              "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ӏ": "l", "г": "r",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g"}
EDGES = ".,;:!?\"'()[]{}<>*%&$#@|…“”„«»-_=~^`/\\+"
SWAP_COST, REPEAT_COST, SEPARATOR_COST, BOUNDARY_COST, GAP_COST, LETTER_GAIN = 1.0, 0.3, 0.1, 1.5, 1.0, 2.5
HAS_LETTER = re.compile(r"[^\W\d_]")
REPEATS = re.compile(r"(.)\1\1")
TWICE = re.compile(r"(.)\1+")
_EDGE = f"[{re.escape(EDGES)}]"
_SINGLE = rf"(?:{_EDGE}(?!\S)|{_EDGE}*+[^\s{re.escape(EDGES)}]{_EDGE}*+(?!\S))"
SINGLES = re.compile(rf"(?<!\S){_SINGLE}(?:\s++{_SINGLE}){{2,}}+")
ODD = re.compile(r"(?<!\S)[a-zß-öù-ÿ]*+[^a-zß-öù-ÿ\s]\S*+")
UNSEEN = re.compile("[\u00ad\u0300-\u036f\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u20d0-\u20ff\ufe00-\ufe0f\ufeff]")


def letter_classes() -> np.ndarray:
    """Class of each code point below 0x30000: 0 other, 1-26 a-z, then the accented letters of Latin-1, then hashes of other letters."""
    out = np.zeros(0x30000, np.uint8)
    for c in range(0x100, 0x30000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = 60 + c % 68
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)] = i + 1
    for i, c in enumerate(range(0xDF, 0x100)):
        out[c] = 27 + i
    return out


CLASS = letter_classes()


def codes(text: str) -> np.ndarray:
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(CLASS) - 1)].astype(np.int64)


def folded(text: str) -> str:
    """Lower case, compatibility forms, nothing invisible."""
    text = text.lower()
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text).lower()
    return UNSEEN.sub("", text)


def counted(held: list[np.ndarray]) -> np.ndarray:
    c = np.concatenate([[0, 0], *held])
    return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


def _trigrams(batches):
    total, held, size = np.zeros(CLASSES**3, np.int64), [], 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            if text:
                held.append(codes(f" {folded(text)} "))
                size += len(held[-1])
            if size > BLOCK:
                total += counted(held)
                held, size = [], 0
    total += counted(held)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["trigram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(third class | first two), interpolated with lower orders."""
    counted = docs.select(text_col).mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros(CLASSES**3)
    full[counted["trigram"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    three = full.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def base_letter(c: str) -> str:
    """The letter below an accent; '' if there is none."""
    return (unicodedata.normalize("NFD", c)[0] if not c.isascii() and unicodedata.decomposition(c) else "").lower()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each stretch of the token, what it may stand for and the channel's cost."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run, i = j - i, j
        letters = [(x, SWAP_COST) for x in LOOKALIKES.get(c, "") + base_letter(c)]
        if HAS_LETTER.match(c):
            letters.append((c, 0.0))
        options = []
        for x, cost in letters:
            options.append((x, cost + REPEAT_COST * (run > 1)))
            if run > 1:
                options.append((x + x, cost + (REPEAT_COST if run > 2 else 0.0)))
        if not c.isalnum():
            options += [("", SEPARATOR_COST), (" ", BOUNDARY_COST)]
        if not options:
            return []
        out.append(options)
    return out


def spaced(options: list[list[tuple[str, float]]]) -> list[list[tuple[str, float]]]:
    """The lattice with a word boundary before any letter."""
    out = []
    for stretch in options:
        split = [(" ".join(p), cost) for p, cost in stretch if len(p) > 1]
        out.append([*stretch, *split, *((" " + p, cost) for p, cost in [*stretch, *split] if p.strip())])
    return out


def viterbi(model: np.ndarray, token: str, boundaries: bool = False) -> str:
    """The best reading of a token; the token itself if it has none."""
    states = {(0, 0): (0.0, None)}
    stages = lattice(token)
    if boundaries:
        stages = spaced(stages)
    for options in [*stages, [("\n", 0.0)]] if stages else []:
        options = [(piece, cost - LETTER_GAIN * (len(piece) - piece.count(" ")), codes(piece).tolist() if piece else ()) for piece, cost in options]
        new: dict = {}
        for (a, b), (score, path) in states.items():
            for piece, cost, classes in options:
                s, x, y = score - cost, a, b
                for k in classes:
                    s += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, (path, piece))
        states = new
    if not stages:
        return token
    path, pieces = max(states.values(), key=lambda v: v[0])[1], []
    while path:  # back pointers: a long token costs no copies of its reading
        path, piece = path
        pieces.append(piece)
    return "".join(reversed(pieces)).strip()


def looks_like(token: str) -> bool:
    """Whether a token has letters of other scripts that may stand for Latin ones, among these or all alike."""
    return not token.isascii() and any(c in LOOKALIKES for c in token) and (any("a" <= c <= "z" for c in token) or all(c in LOOKALIKES for c in token))


def restore(model: np.ndarray, token: str, cache: dict) -> str:
    """The word behind a token of a folded text; with spaces where it holds several."""
    got = cache.get(token)
    if got is None:
        got = token.strip(EDGES)
        if not got.isalpha() or REPEATS.search(got) or token[0] in "$@" or looks_like(got):
            inner = token.rstrip(EDGES.replace("$", "").replace("@", "")).lstrip(EDGES.replace("$", "").replace("@", "").replace("(", ""))
            if HAS_LETTER.search(inner) and len(inner) >= 3:
                got = viterbi(model, inner)
        if len(cache) > CACHED:
            cache.clear()
        cache[token] = got
    return got


PLAIN = {c: base_letter(chr(c)) for c in range(0xC0, 0x250) if base_letter(chr(c))} | {ord(c): x[0] for c, x in LOOKALIKES.items()}


def skeleton(word: str) -> str:
    """A word without accents and repeats, look-alikes replaced by the first letter they stand for."""
    return TWICE.sub(r"\1", word if word.isascii() else word.translate(PLAIN))


def single_runs(text: str) -> list[str]:
    """Runs of three or more single characters that can be read, joined; edges around each do not count."""
    out = ["".join(t if len(t) < 2 else t.strip(EDGES) for t in m[0].split()) for m in SINGLES.finditer(text)]
    return [r for r in out if HAS_LETTER.search(r)]


def words(model: np.ndarray, text: str | None, cache: dict) -> tuple[set[str], list[str], set[str], dict[str, str]]:
    """The restored words of a text, its tokens, the readings of runs of single characters (without spaces), and of each token that is
    not read as it stands."""
    text = folded(text or "")
    tokens = text.split()
    found = set(tokens)
    together = " ".join(found)
    odd = ODD.findall(together)  # what has more than plain and accented letters; most tokens have not
    if REPEATS.search(together):
        odd += [t for t in found if REPEATS.search(t)]
    read = {t: cache.get(t) or restore(model, t, cache) for t in odd}
    found.difference_update(odd)
    for r in set(read.values()):
        if " " in r:
            found.update(r.split(), [r.replace(" ", "")])
        else:
            found.add(r)
    runs = set()
    for run in set(single_runs(text)):
        split = viterbi(model, run, True).split()
        whole = restore(model, run, cache).replace(" ", "")
        found.update(split, [whole])
        runs |= {"".join(split), whole}
    found.discard("")
    return found, tokens, runs, read


class Lexicon:
    """Weights of features, and what tells which tokens could be read as one of them."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.words = {f for f in weights if not f.endswith("~")}
        self.heads = {f[:k] for f in self.words for k in range(1, len(f))}
        self.tails = {f[k:] for f in self.words for k in range(1, len(f))}
        self.skeletons = {skeleton(f) for f in weights}
        self.stems = sorted({len(x) - 1 for x in self.skeletons if x.endswith("~")})
        self.lengths = sorted({len(f.rstrip("~")) for f in weights})
        self.starts = {f[:3] for f in weights}
        for a, b, c in {(x.rstrip("~") + "  ")[:3] for x in self.skeletons}:  # what a word of this skeleton may begin with
            self.starts |= {s.rstrip() for s in (a, a + a, a + a + a, a + b, a + a + b, a + b + b, a + b + c)}

    def candidates(self, found: set[str]) -> list[str]:
        """Words that begin like an entry (accents and look-alikes replaced); no other word can have a weight."""
        starts = self.starts
        return [w for w in found if (p := w[:3]) in starts or (not p.isascii() and p.translate(PLAIN) in starts)]

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def resembles(self, word: str) -> bool:
        """Whether a word that is no entry has the skeleton of one."""
        if word.isascii() and not TWICE.search(word):
            return False
        plain = skeleton(word)
        if plain in self.skeletons:
            return True
        for k in self.stems:
            if plain[:k] + "~" in self.skeletons:
                return True
        return False


def log_likelihood(model: np.ndarray, text: str) -> float:
    c = np.concatenate([[0, 0], codes(f"{text} ")])
    return float(model[c[:-2], c[1:-1], c[2:]].sum())


def joined_words(model: np.ndarray, lexicon: Lexicon, found: set[str], tokens: list[str], read: dict[str, str]) -> set[str]:
    """Entries of the lexicon that neighbouring tokens make together, if the model takes the word to be likelier than the parts."""
    out: set[str] = set()
    heads = lexicon.heads & found
    if not heads or lexicon.tails.isdisjoint(found):
        return out
    readings = [read.get(t, t) for t in tokens]
    for i in [i for i, r in enumerate(readings) if r in heads]:
        word = readings[i]
        for j in range(i + 1, len(readings)):
            word += readings[j]
            if word in lexicon.words and log_likelihood(model, word) - GAP_COST * (j - i) >= log_likelihood(model, " ".join(readings[i : j + 1])):
                out.add(word)
            if not readings[j] or word not in lexicon.heads:
                break
    return out


def run_hits(weights: dict[str, float], lengths: list[int], run: str) -> dict[str, float]:
    """Entries of the lexicon in a run: those that do not overlap and weigh most in all."""
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    for end in range(1, len(run) + 1):
        top = (best[end - 1][0], end - 1, "")
        for n in lengths:
            if n <= end:
                word = run[end - n : end]
                weight = max(weights.get(word, 0.0), weights.get(word + "~", 0.0) if end < len(run) else 0.0)
                if weight and best[end - n][0] + weight > top[0]:
                    top = (best[end - n][0] + weight, end - n, word)
        best.append(top)
    out, end = {}, len(run)
    while end:
        total, before, word = best[end]
        if word:
            out[word] = total - best[before][0]
        end = before
    return out


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in (4, 5, 6) if len(word) > n)]


def _feature_counts(told, batches):
    model, cache, toxic, other = told.value, {}, Counter(), Counter()

    def summed():
        names = list(toxic.keys() | other.keys())
        rows = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([other[x] for x in names], pa.int64())], ["feature", "toxic", "other"])
        toxic.clear(), other.clear()
        return rows

    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = words(model, text, cache)[0]
            (toxic if label else other).update(found.union(*({f"{w[:n]}~" for w in found if len(w) > n} for n in (4, 5, 6))))
        if len(toxic) + len(other) > 3 * CACHED:
            yield summed()
    yield summed()


def numbers(model: np.ndarray, lexicon: Lexicon, text: str | None, cache: dict, weights: dict) -> list[float]:
    """The four inputs of the logistic model."""
    found, tokens, runs, read = words(model, text, cache)
    found |= joined_words(model, lexicon, found, tokens, read)
    hits = []
    for w in lexicon.candidates(found):
        x = weights.get(w)
        if x is None:
            x = lexicon.weight(w)
            if not x and lexicon.resembles(w):
                x = max(map(lexicon.weight, viterbi(model, w).split()), default=0.0)
            if len(weights) > CACHED:
                weights.clear()
            weights[w] = x
        if x:
            hits.append(x)
    if runs:
        more = {w: x for run in runs for w, x in run_hits(lexicon.weights, lexicon.lengths, run).items()}
        known = {f.rstrip("~") for w in found for f in features(w)}
        hits += [x for w, x in more.items() if w not in known]
    return [max(hits, default=0.0), math.log1p(sum(hits)), math.log1p(len(hits)), min(1.0, 10 * len(hits) / max(len(tokens), 1))]


def _inputs(told, columns, batches):
    """The columns kept and the four inputs of each text (the last column)."""
    (model, lexicon), cache, weights = told.value, {}, {}
    for batch in slices(batches):
        rows = np.array([numbers(model, lexicon, t, cache, weights) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, 4)
        kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, k]) for k in range(4))], [*columns, *INPUTS])


def lexicon_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Lexicon, DataFrame]:
    """The language model, the lexicon, and the labels it was learnt from (doc_id, toxic)."""
    spark = docs.sparkSession
    model = language_model(docs, text_col)
    open_ = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    open_ = open_.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(MAX_LABELLED)
    open_ = materialize(open_, "labels")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small(open_), "doc_id").select("text", "toxic")
    told = spark.sparkContext.broadcast(model)
    counts = texts.mapInArrow(partial(_feature_counts, told), "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = {int(r["toxic"] > 0): r["count"] for r in open_.groupBy("toxic").count().collect()}
    yes, no = max(totals.get(1, 0), 1), max(totals.get(0, 0), 1)
    share = F.lit(yes / (yes + no))
    a, n = F.col("toxic"), F.col("toxic") + F.col("other")
    g = 2 * (F.when(a > 0, a * F.ln(a / (n * share))).otherwise(0.0) + F.when(n > a, (n - a) * F.ln((n - a) / (n * (1 - share)))).otherwise(0.0))
    weight = F.ln((a + 0.5) / (yes + 1.0)) - F.ln((n - a + 0.5) / (no + 1.0))
    strong = counts.select("feature", weight.alias("weight"), g.alias("g")).where("weight >= 2 and g >= 25").orderBy(F.desc("g"), "feature").limit(LEXICON)
    return model, Lexicon({r["feature"]: r["weight"] for r in strong.collect()}), open_


def inputs(docs: DataFrame, model: np.ndarray, lexicon: Lexicon, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep and the inputs of each row."""
    told = docs.sparkSession.sparkContext.broadcast((model, lexicon))
    schema = docs.select(*keep).withColumns({c: F.lit(0.0) for c in INPUTS}).schema
    return docs.select(*keep, F.col(text_col).alias("mq_text")).mapInArrow(partial(_inputs, told, keep), schema)


def fitted(labelled: DataFrame) -> np.ndarray:
    """The coefficients of the logistic model from rows of inputs and toxic, counted in groups of rounded inputs."""
    rounded = [F.round(c, 1).alias(c) for c in INPUTS]
    grouped = labelled.groupBy(*rounded).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).orderBy(F.desc("n"), *INPUTS).limit(MAX_FITTED).toPandas()
    if not len(grouped):
        return np.array([0.0, 0.0, 0.0, 0.0, math.log(0.05 / 0.95)])
    return fit_grouped(grouped[INPUTS].to_numpy(), grouped["toxic"].to_numpy(np.float64), grouped["n"].to_numpy(np.float64))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Lexicon, np.ndarray]:
    """The language model, the lexicon and the coefficients."""
    model, lexicon, open_ = lexicon_of(docs, labels, id_col, text_col)
    rows = inputs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small(open_), "doc_id"), model, lexicon, ["toxic"])
    return model, lexicon, fitted(rows)


def fit_grouped(x: np.ndarray, toxic: np.ndarray, n: np.ndarray, penalty: float = 0.1, steps: int = 40) -> np.ndarray:
    """Logistic regression on counted groups by Newton steps; the constant is last and hardly penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((toxic.sum() + 0.5) / (n.sum() - toxic.sum() + 0.5))
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * p - toxic) + ridge @ w)
        w = w - step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all of docs if None) and mq_score of every row. Inputs are worked out once for each text and written; the labelled
    rows among them fit the model, whose score is an expression."""
    keep = docs.columns if keep is None else keep
    with small_batches(docs.sparkSession):
        model, lexicon, open_ = lexicon_of(docs, labels, id_col, text_col)
        every = materialize(inputs(docs.withColumn("mq_id", F.col(id_col)), model, lexicon, [*keep, "mq_id"], text_col), "inputs")
        w = fitted(every.select("mq_id", *INPUTS).join(small(open_.withColumnRenamed("doc_id", "mq_id")), "mq_id"))
    release(open_)
    total = F.lit(float(w[4]))
    for c, x in zip(INPUTS, w):
        total = total + F.col(c) * float(x)
    total = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))
    out = every.select(*keep, (1 / (1 + F.exp(-total))).alias("mq_score"))
    out._meshquill_path = every._meshquill_path  # so that release() can delete the inputs
    return out


def less_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold. Only ids, digests of texts and texts go to Python, and only what is rejected
    meets the rows again, by its digest: in a broadcast where it is small. Reads docs twice."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    scored = toxicity(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("mq_key")), labels, keep=["mq_key"])
    rejected = materialize(scored.where(F.col("mq_score") >= threshold).select("mq_key").distinct(), "rejected")
    release(scored)
    return docs.withColumn("mq_key", digest).join(small(rejected), "mq_key", "left_anti").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("mq_score").alias("score"), (F.col("mq_score") >= THRESHOLD).cast("int").alias("predicted"))
