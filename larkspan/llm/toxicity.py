"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Stretches that look disguised - digits or signs amid letters, letters spread by
separators, letters repeated - become lattices: each observed character can be
itself, the letter it stands for, nothing (a separator or a repetition) or a
word break, at the channel's cost. Viterbi decoding under a character trigram
model picks the likeliest reading. A text's words are those it has and those it
is restored to.

The score is a logistic model over a lexicon of words and word beginnings. Both,
and the trigram model, are learnt from the whole texts of all labelled documents
whose crc32(doc_id as text) mod 3 isn't 1. The
lexicon is chosen greedily: each entry is the one that explains most toxic
documents not explained DEPTH times yet, so that words which merely come along
with copies of a toxic text stay out. How many documents an entry must explain
follows from the share of toxic ones alone, at every size.

Defined results: a null or empty text has no words and gets the score of the
intercept, rounded like all scores. Without labels of both kinds every score is
0. Every input row gives one output row; whole texts are scored.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import discard, small_batches, stored, table, tidy, works_for

FOLDS, HELD_OUT = 3, 1
CUT = 0.7
#: Word beginnings that can be lexicon entries.
HEADS = (4, 5, 6, 7, 8)
#: Such a beginning counts by how many distinct words have it, up to this.
WORDS_OF_HEAD = 3
LEAST_RATIO, DEPTH = 3.0, 3
#: An entry must explain so many toxic documents that, had they been drawn from all labelled ones, all of them being toxic would be no likelier than this.
CHANCE = 0.01
#: Tokens that a task remembers, with what they give.
CACHE = 100_000
#: Texts whose words are held at a time.
FEW = 50
#: Words or entries that a task counts before it hands the counts on.
COUNTED = 300_000
#: Labels that are broadcast at a time.
AT_ONCE = 1_000_000
#: Rows of the logistic model's matrix that are held at a time.
MATRIX_ROWS = 20_000

WORDS = re.compile(r"[^\W\d_]+")
#: Signs and the letters they can stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
SIGNS = re.escape("".join(STANDS_FOR))
LETTER = r"[^\W\d_]"
UNIT = r"(?:[^\W_]|[@$!])"
#: Here and below nothing backtracks over a run of letters, and runs are only entered at their start, so the time is linear in the text.
SPREAD = re.compile(rf"(?<!\w){UNIT}(?:[ .\-_*]++{UNIT}){{2,}}(?!\w)")
#: Within a token: signs amid letters, or repeated letters.
DISGUISED = re.compile(
    rf"(?<!{LETTER})[{SIGNS}]{{0,2}}(?:{LETTER}++[{SIGNS}*._\-]{{1,3}}+)+{LETTER}++|(?<!\S)[{SIGNS}]{{1,2}}{LETTER}{{2,}}+"
    rf"|(?<!{LETTER})(?:({LETTER})(?!\1\1))*+({LETTER})\2\2{LETTER}*+"
)
SEPARATORS = set(" .-_*")
#: How such a stretch goes on behind its first character. It starts with a set of characters, which is searched for several times faster.
SPREAD_ON = re.compile(rf"[ .\-_*](?:(?<=\W{UNIT}[ .\-_*])|(?<=\A{UNIT}[ .\-_*]))[ .\-_*]*+{UNIT}[ .\-_*]++{UNIT}(?![^\W_])")
#: Behind a token's only word these disguise nothing.
ENDS = string.punctuation + string.digits
THRICE = re.compile(rf"({LETTER})\1\1")
#: Longer tokens aren't remembered.
LONG = 64
COST = {"stands": 0.7, "drop": 0.4, "break": 2.5, "repeat": 0.3, "sign": 6.0}


def grams(words: Counter) -> Counter:
    """Counts of (order, character after its context) for contexts of 0, 1 and 2 characters, over words between spaces."""
    longest: Counter = Counter()
    for w, k in words.items():
        s = f"  {w} "
        for i in range(len(w) + 1):
            longest[s[i : i + 3]] += k
    out: Counter = Counter()
    for gram, k in longest.items():
        for order in range(3):
            out[order, gram[2 - order :]] += k
    return out


class CharModel:
    """Interpolated character trigrams over words between spaces."""

    def __init__(self, counts: Counter) -> None:
        """counts: as grams() gives them."""
        n: list[Counter] = [Counter(), Counter(), Counter()]
        of: list[Counter] = [Counter(), Counter(), Counter()]
        for (order, gram), k in counts.items():
            n[order][gram] += k
            of[order][gram[:-1]] += k
        self.n, self.of, self.cache, self.size = n, of, {}, len(n[0]) + 1

    def cost(self, before: str, c: str) -> float:
        key = before + c
        if (x := self.cache.get(key)) is None:
            p = (self.n[0][c] + 1) / (self.of[0][""] + self.size)
            for order in (1, 2):
                ctx = before[2 - order :]
                p = (self.n[order][ctx + c] + 4 * p) / (self.of[order][ctx] + 4)
            x = self.cache[key] = -math.log(p)
        return x


def restored(stretch: str, model: CharModel) -> str:
    """The likeliest reading: lower-case words between single spaces."""
    best: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}  # the last two characters read -> cost, what was read
    last = ""
    for c in stretch.lower() + " ":
        reads: list[tuple[str, float]] = []
        if c in SEPARATORS:
            reads = [("", COST["drop"] * (c != last)), (" ", COST["break"])]
        elif c in STANDS_FOR:
            reads = [(x, COST["stands"]) for x in STANDS_FOR[c]] + [("", COST["sign"])]
            if c == last:
                reads.append(("", COST["repeat"]))
        else:
            reads = [(c, 0.0)]
            if c == last:
                reads.append(("", COST["repeat"]))
        nxt: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in best.items():
            for x, channel in reads:
                if x == " " and state[1] == " ":
                    x = ""
                new = cost + channel + (model.cost(state, x) if x else 0.0)
                key = state[1] + x if x else state
                if key not in nxt or new < nxt[key][0]:
                    nxt[key] = (new, (path, x) if x else path)
        best, last = nxt, c
    # the end is a word's end
    cost, path = min(((cost + (0.0 if s[1] == " " else model.cost(s, " ")), path) for s, (cost, path) in best.items()), key=lambda t: t[0])
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out)).strip()


def lowered(text: str) -> str:
    low = text.lower()
    return low if low.isascii() or unicodedata.is_normalized("NFC", low) else unicodedata.normalize("NFC", low)


def token_parts(token: str) -> tuple[list[str], list[str]]:
    """The words of a token without white space, as it stands, and its stretches that look disguised."""
    word = token.rstrip(ENDS)
    if word.isalpha() and not THRICE.search(word):
        return [word], []
    return WORDS.findall(token), [m[0] for m in DISGUISED.finditer(token)]


def spread(low: str) -> list[str]:
    """The stretches of a lower-case text whose letters are spread by separators."""
    return [m[0] for m in SPREAD.finditer(low)] if SPREAD_ON.search(low) else []


class Reader:
    """Takes texts apart, and remembers tokens."""

    def __init__(self) -> None:
        self.plain: set[str] = set()  # tokens that are one word and nothing else
        self.known: dict[str, tuple[list[str], list[str]]] = {}

    def parts(self, text: str) -> tuple[set[str], set[str]]:
        """A text's distinct words, as they stand, and its distinct stretches that look disguised."""
        low = lowered(text)
        tokens = set(low.split())
        words, stretches = tokens & self.plain, set(spread(low))
        for token in tokens - words:
            got = self.known.get(token)
            if got is None:
                got = token_parts(token)
                if len(self.plain) + len(self.known) >= CACHE:
                    self.plain.clear()
                    self.known.clear()
                if len(token) <= LONG:
                    if got == ([token], []):
                        self.plain.add(token)
                    else:
                        self.known[token] = got
            words.update(got[0])
            if got[1]:
                stretches.update(got[1])
        return words, stretches


def words_of(text: str, model: CharModel | None) -> set[str]:
    """A text's distinct words, restored ones included."""
    words, stretches = Reader().parts(text)
    if model is not None:
        for stretch in stretches:
            words.update(restored(stretch, model).split())
    return words


def entries(words: set[str]) -> set[str]:
    """Lexicon entries that a text can have: whole words, and beginnings with a star and a number: at least so many of the text's words begin like that."""
    out = set(words)
    for k in HEADS:
        for head, n in Counter([w[:k] for w in words if len(w) >= k]).items():
            out.update([f"{head}*{i}" for i in range(1, min(n, WORDS_OF_HEAD) + 1)])
    return out


class Tally:
    """How many documents have each of the entries that entries() gives, without making these document by document."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.heads = {k: [Counter() for _ in range(WORDS_OF_HEAD)] for k in HEADS}

    def add(self, words: list[str]) -> None:
        """A document's distinct words."""
        self.words.update(words)
        for k, by_number in self.heads.items():
            words = [w for w in words if len(w) >= k]
            of = Counter([w[:k] for w in words])
            have = list(of)
            for i, docs in enumerate(by_number):
                if i:
                    have = [h for h in have if of[h] > i]
                docs.update(have)

    def __len__(self) -> int:
        return len(self.words) + sum(len(docs) for by_number in self.heads.values() for docs in by_number)

    def counts(self) -> Iterator[tuple[list[str], list[int]]]:
        """Entries and how many documents have them, a part at a time."""
        yield list(self.words), list(self.words.values())
        for by_number in self.heads.values():
            for i, docs in enumerate(by_number, 1):
                yield [f"{h}*{i}" for h in docs], list(docs.values())


class ToxicModel:
    def __init__(self, chars: CharModel | None, weights: dict[str, float], intercept: float) -> None:
        self.chars, self.weights, self.intercept = chars, weights, intercept
        self.heads = {e[:-1] for e in weights if e[-2:-1] == "*"}
        self.begin = beginnings(self.heads)
        self.none: set[str] = set()  # tokens without entries
        self.known: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"none": set(), "known": {}}

    def hits(self, words: list[str]) -> tuple[tuple[str, str], ...]:
        """(entry without its number, word) of those that the lexicon knows."""
        words = [w for w in words if w in self.weights or w[: HEADS[0]] in self.begin]
        return tuple({(w, w) for w in words if w in self.weights} | {(h, w) for w in words for k in HEADS if len(w) >= k and (h := w[:k] + "*") in self.heads})

    def read(self, words: list[str], stretches: list[str]) -> list[str]:
        """The words and those that the stretches are restored to."""
        if stretches and self.chars is not None:
            words = words + [w for s in stretches for w in restored(s, self.chars).split()]
        return words

    def score(self, text: str | None) -> float:
        low, none, known = lowered(text or ""), self.none, self.known
        found: set[tuple[str, str]] = set()
        new = set(low.split()) - none
        if len(none) + len(known) + len(new) > CACHE:
            none.clear()
            known.clear()
        # without repeated letters a token of one word is only that word
        odd = new if THRICE.search(" ".join(new)) else {t for t in new if len(t) > LONG or not (w := t.rstrip(ENDS)).isalpha() or w in self.weights or w[: HEADS[0]] in self.begin}
        if len(new) <= CACHE:
            none.update(new - odd)
        for token in odd:
            got = known.get(token)
            if got is None:
                got = self.hits(self.read(*token_parts(token)))
                if len(none) + len(known) < CACHE and len(token) <= LONG:
                    if got:
                        known[token] = got
                    else:
                        none.add(token)
            found.update(got)
        found.update(self.hits(self.read([], spread(low))))
        have = set()
        for e, n in Counter(e for e, _ in found).items():
            have.update([f"{e}{i}" for i in range(1, min(n, WORDS_OF_HEAD) + 1)] if e[-1] == "*" else [e])
        z = self.intercept + sum(sorted(self.weights[e] for e in have if e in self.weights))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 6)


def least_docs(toxic: int, clean: int) -> int:
    """How many toxic documents an entry must explain."""
    return max(2, math.ceil(math.log(CHANCE) / math.log(toxic / (toxic + clean)) - 1e-9))


def odds(there: int, toxic: int, against: int, clean: int) -> float:
    """How much likelier an entry is in a toxic document, as a logarithm."""
    return math.log((there + 0.5) / (toxic + 1)) - math.log((against + 0.5) / (clean + 1))


def chosen_entries(docs: dict[str, list[int]], against: dict[str, int], size: list[int], least: int) -> list[str]:
    """Of entries with the groups of toxic documents that have them (size: documents of a group) and the number of clean ones: chosen greedily by how many toxic documents they explain anew."""
    left, out = [DEPTH] * len(size), []
    total = {e: sum(size[i] for i in d) for e, d in docs.items()}
    # a longer or whole entry is preferred to a shorter one that explains the same documents
    queue = sorted(docs, key=lambda e: (-total[e], against[e], "*" in e, -len(e), e))
    gain = dict(total)
    while queue:
        top, at = 0, None
        for e in queue:
            if gain[e] <= top:
                break
            gain[e] = sum(size[i] for i in docs[e] if left[i] > 0)
            if gain[e] > top:
                top, at = gain[e], e
        if at is None or top < least:
            break
        out.append(at)
        held = set(docs[at])
        for i in held:
            left[i] -= 1
        # an entry that explains the very same documents adds nothing
        queue = sorted((e for e in queue if e != at and not (len(docs[e]) == len(held) and held.issuperset(docs[e]))), key=lambda e: (-gain[e], against[e], "*" in e, -len(e), e))
    return out


def lexicon(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """The lexicon of documents given by their words."""
    docs: dict[str, list[int]] = defaultdict(list)
    against: Counter = Counter()
    for i, words in enumerate(toxic):
        for e in entries(words):
            docs[e].append(i)
    for words in clean:
        against.update(entries(words) & docs.keys())
    least = least_docs(len(toxic), len(clean))
    docs = {e: d for e, d in docs.items() if len(d) >= least and odds(len(d), len(toxic), against[e], len(clean)) >= LEAST_RATIO}
    return chosen_entries(docs, against, [1] * len(toxic), least)


def weighed(chars: CharModel, chosen: list[str], rows: list[tuple[set[str], int, int]]) -> ToxicModel:
    """The logistic model over the chosen entries, from those that documents have, their label and how many documents these are."""
    place = {e: i for i, e in enumerate(chosen)}
    had = [np.array([place[e] for e in have if e in place], np.int32) for have, _, _ in rows]
    y, n = np.array([float(label) for _, label, _ in rows]), np.array([float(k) for *_, k in rows])
    w = np.zeros(len(chosen) + 1)
    weight = np.where(y > 0, 0.5 / max(1, (n * y).sum()), 0.5 / max(1, (n * (1 - y)).sum())) * n.sum() * n
    penalty = np.full(len(w), 0.02)
    penalty[-1] = 20.0  # a clean text has no entries, so the data alone would push it without bound
    for _ in range(25):  # Newton steps, with a small penalty on all but the intercept
        gradient, hessian = penalty * w, np.diag(penalty)
        for lo in range(0, len(rows), MATRIX_ROWS):
            part = slice(lo, lo + MATRIX_ROWS)
            x = np.zeros((len(had[part]), len(w)))
            x[np.repeat(np.arange(len(x)), [len(h) for h in had[part]]), np.concatenate(had[part])] = 1
            x[:, -1] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = gradient + x.T @ (weight[part] * (p - y[part]))
            hessian = hessian + (x * (weight[part] * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x
        w -= np.clip(np.linalg.solve(hessian, gradient), -4, 4)
    weights = {e: float(v) for e, v in zip(chosen, w, strict=False) if v > 0}
    return ToxicModel(chars, weights, float(w[-1]))


def fitted(texts: list[tuple[str, int]]) -> ToxicModel:
    """The model from labelled texts, all in one place."""
    counts: Counter = Counter()
    for t, _ in texts:
        counts.update(words_of(t, None))
    chars = CharModel(grams(counts))
    sides = [[words_of(t, chars) for t, y in texts if y == side] for side in (0, 1)]
    if not all(sides):
        return ToxicModel(None, {}, -30.0)
    chosen = lexicon(sides[1], sides[0])
    return weighed(chars, chosen, [(entries(words), y, 1) for y, side in enumerate(sides) for words in side])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def beginnings(heads: set[str]) -> set[str]:
    """What a word must begin with to have one of these heads."""
    return {h[: HEADS[0]] for h in heads}


def had(words: list[str], known: set[str], heads: set[str], begin: set[str]) -> list[str]:
    """Which of the known entries a text with these words has; heads: beginnings that known entries have, with their star; begin: beginnings(heads)."""
    found = [w for w in words if w in known]
    words = [w for w in words if w[: HEADS[0]] in begin]
    for k in HEADS:
        of = Counter([h for w in words if len(w) >= k and (h := w[:k] + "*") in heads])
        found += [e for h, n in of.items() for i in range(1, min(n, WORDS_OF_HEAD) + 1) if (e := f"{h}{i}") in known]
    return sorted(set(found))


def labelled(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """text, y of the documents that usable (_id, _y) lists. Texts stay where they are read: the labels go to them, AT_ONCE or so at a time, for each of which the documents are read again."""
    usable = stored(usable, "usable")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    parts = -(-usable.count() // AT_ONCE) or 1
    out = None
    for i in range(parts):
        some = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(parts)) == i)
        met = rows.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("text", F.col("_y").alias("y"))
        out = met if out is None else out.unionByName(met)
    return out


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """The model from all labelled documents that aren't held out.

    Executors read the texts once and take them apart; what they write has the
    words and the disguised stretches, which are restored once the trigrams are
    counted. The driver gets trigram counts, the entries that are common and
    toxic enough, the toxic documents grouped by which of them they have, and
    all documents grouped by which of the chosen ones they have.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)").filter(~held_out(F.col("_id"))).distinct()

    def taken_apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for f in frames:
            for at in range(0, len(f), FEW):
                part = f.iloc[at : at + FEW]
                of = [reader.parts(t) for t in part["text"]]
                yield pd.DataFrame({"y": part["y"].to_numpy(), "words": [" ".join(words) for words, _ in of], "stretches": ["\n".join(stretches) for _, stretches in of]})

    held = stored(labelled(docs, usable).mapInPandas(tidy("toxicity", taken_apart), "y int, words string, stretches string"), "parts")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()

        def found() -> pd.DataFrame:
            of = grams(n)
            return pd.DataFrame({"o": [o for o, _ in of], "gram": [g for _, g in of], "n": list(of.values())})

        for f in frames:
            for words in f["words"]:
                n.update(words.split())
                if len(n) >= COUNTED:
                    yield found()
                    n.clear()
        if n:
            yield found()

    counts = held.select("words").mapInPandas(tidy("toxicity", counted), "o int, gram string, n long").groupBy("o", "gram").agg(F.sum("n").alias("n"))
    chars = CharModel(Counter({(r["o"], r["gram"]): r["n"] for r in counts.collect()}))
    model = spark.sparkContext.broadcast(chars)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}

        def whole(words: str, stretches: str) -> str:
            out = set(words.split())
            for stretch in stretches.split("\n"):
                got = known.get(stretch)
                if got is None:
                    got = restored(stretch, model.value).split()
                    if len(known) >= CACHE:
                        known.clear()
                    if len(stretch) <= LONG:
                        known[stretch] = got
                out.update(got)
            return " ".join(out)

        for f in frames:
            for at in range(0, len(f), FEW):
                part = f.iloc[at : at + FEW]
                yield pd.DataFrame({"y": part["y"].to_numpy(), "words": [whole(w, s) if s else w for w, s in zip(part["words"], part["stretches"], strict=True)]})

    read_ = stored(held.mapInPandas(tidy("toxicity", read), "y int, words string"), "words")
    model.destroy()
    discard(held)
    size = {r["y"]: r["n"] for r in read_.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        discard(read_)
        return ToxicModel(None, {}, -30.0)
    least = least_docs(toxic, clean)

    def tallied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = [Tally(), Tally()]

        def found() -> Iterator[pd.DataFrame]:
            for y, side in enumerate(sides):
                sides[y] = Tally()
                for names, n in side.counts():
                    if names:
                        yield pd.DataFrame({"entry": names, "there": [y * k for k in n], "against": [(1 - y) * k for k in n]})

        for f in frames:
            for y, words in zip(f["y"], f["words"], strict=True):
                sides[y].add(words.split())
                if len(sides[0]) + len(sides[1]) >= COUNTED:
                    yield from found()
        yield from found()

    totals = read_.mapInPandas(tidy("toxicity", tallied), "entry string, there long, against long").groupBy("entry").agg(F.sum("there").alias("there"), F.sum("against").alias("against"))
    ratio = F.log((F.col("there") + 0.5) / (toxic + 1)) - F.log((F.col("against") + 0.5) / (clean + 1))
    good = totals.filter((F.col("there") >= least) & (ratio >= LEAST_RATIO)).select("entry", "against").collect()
    against = {r["entry"]: r["against"] for r in good}
    explains: dict[str, list[int]] = {e: [] for e in against}
    group: list[int] = []
    for having, _, n in _groups(read_.filter("y = 1"), list(against)):
        for e in having:
            explains[e].append(len(group))
        group.append(n)
    words = chosen_entries(explains, against, group, least)
    del explains
    out = weighed(chars, words, _groups(read_, words))
    discard(read_)
    return out


def _groups(texts: DataFrame, known: list[str]) -> list[tuple[list[str], int, int]]:
    """Which of the known entries texts (y, words) have, y, and how many texts that are."""
    at = {e: i for i, e in enumerate(sorted(known))}
    names = sorted(known)
    heads = {e[:-1] for e in known if e[-2:-1] == "*"}
    held = texts.sparkSession.sparkContext.broadcast((set(known), heads, beginnings(heads), at))

    def which(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries_, heads, begin, place = held.value
        for f in frames:
            yield pd.DataFrame({"y": f["y"], "have": [[place[e] for e in had(words.split(), entries_, heads, begin)] for words in f["words"]]})

    groups = texts.mapInPandas(tidy("toxicity", which), "y int, have array<int>").groupBy("y", "have").agg(F.count(F.lit(1)).alias("n"))
    out = sorted((list(r["have"]), r["y"], r["n"]) for r in groups.collect())
    held.destroy()
    return [([names[i] for i in have], y, n) for have, y, n in out]


def score_column(spark: SparkSession, model: ToxicModel, text: str | Column = "text") -> Column:
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # a lexicon and trigram counts

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        works_for("toxicity")
        model = held.value
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without those whose score reaches CUT."""
    return docs.filter(score_column(docs.sparkSession, train(docs, labels)) < CUT)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
