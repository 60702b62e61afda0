"""Abusive, hateful or sexual content (problem 9): the model.

Method: multiple-instance learning.  A document is a bag of sentences; each
sentence has a logistic score of its words, and the document's score is the
noisy-or of its sentences, 1 - prod(1 - p).  Only documents are labelled: the
gradient of the document's likelihood moves the sentences that explain it, so
the trained model also says which sentence offends.

Features of a sentence: words, pairs of neighbours and pairs two apart, over the
words of the training sample; quotation marks are words, so a quoted insult
reads differently from an uttered one.  A disguised word is read as the word it
stands for: look-alike and invisible characters, digits for letters, letters
set apart, one typing error.  A word with asterisks is a word of its own.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from newsloom.llm.lookalikes import LOOKS_LIKE, ODD_TEXT, bare

#: Bounds of the labelled sample that the model is fitted on: documents judged abusive, other documents, characters of all of either kind together.
SAMPLE_ABUSIVE, SAMPLE_OTHER, SAMPLE_CHARS = 4_000, 10_000, 30_000_000
#: A feature needs this many documents of the sample.
LEAST_DOCS = 3
#: A word needs this many documents for a mistyped word to be read as it.
KNOWN_DOCS = 4

END_DOC, END_SENTENCE, UNKNOWN, MASKED, QUOTE_OPEN, QUOTE_CLOSE, QUOTE = "\x00", "\n", "<unknown>", "<masked>", "«", "»", '"'
TOKEN = re.compile(r"\w[\w*]*|[\x00\n.!?«»“”„\"‘]")
APART = re.compile(r"(?<![\w.])(?:\w[ .\-_]){2,}\w(?![\w])")
ODD = re.compile(ODD_TEXT.replace("-\\x7e", "-\\x7e\\n"))
LEET = str.maketrans("013457@$", "oieastas")
FOLD = {ord(a): b[0].lower() for a, b in LOOKS_LIKE.items()} | {ord("”"): "»", ord("“"): "«", ord("„"): "«", ord("‘"): "«"}


def sentences(text: str) -> list[str]:
    """The sentences of a text as the model reads them."""
    return re.split(r"[\x00\n.!?]", clean(text))


def clean(text: str) -> str:
    """Lower case, without disguises that can be undone without knowing words."""
    if ODD.search(text):
        text = "\n".join(bare(x) for x in text.split("\n")).translate(FOLD)
    text = text.replace("\x00", " ").lower()
    if APART.search(text):
        text = APART.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), text)
    return text


class Words(dict):
    """Word -> number; a word that isn't known is resolved once and kept."""

    def __init__(self, known: list[str]):
        super().__init__((w, i) for i, w in enumerate(known))
        for mark in ".!?":
            self[mark] = self[END_SENTENCE]
        self.fixed = len(self)
        self.short: dict[str, int] = {}  # a known word with one letter left out -> its number
        for i, w in enumerate(known):
            if len(w) >= 4 and w.isalpha():
                for k in range(len(w)):
                    self.short.setdefault(w[:k] + w[k + 1 :], i)

    def __missing__(self, token: str) -> int:
        if len(self) > 2_000_000:  # what was resolved can be resolved again
            for x in list(self)[self.fixed :]:
                del self[x]
        self[token] = found = self._resolve(token)
        return found

    def _resolve(self, token: str) -> int:
        if "*" in token:
            return self[MASKED]
        plain = token.translate(LEET)
        if plain != token and not token.isdigit() and plain in self:
            return self[plain]
        if len(plain) >= 4 and plain.isalpha():
            if plain in self.short:  # a letter is missing
                return self.short[plain]
            for k in range(len(plain)):
                left = plain[:k] + plain[k + 1 :]
                if left in self:  # a letter too many
                    return dict.__getitem__(self, left)
            for k in range(len(plain)):  # another letter, or two exchanged
                left = plain[:k] + plain[k + 1 :]
                if len(left) >= 4 and left in self.short:
                    return self.short[left]
        return self[UNKNOWN]

    def __reduce__(self):
        return (Words, ([w for w, _ in sorted(((w, i) for w, i in list(self.items())[: self.fixed] if w not in ".!?"), key=lambda x: x[1])],))


class Model:
    """Weights over words and pairs, with the word list."""

    def __init__(self, words: Words, keys: np.ndarray, weights: np.ndarray, bias: float, threshold: float):
        self.words, self.keys, self.weights, self.bias, self.threshold = words, keys, weights, bias, threshold

    # ---- features
    @staticmethod
    def _features(words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence of each feature, key of each feature, document of each sentence, and each sentence's first token and end."""
        joined = END_DOC.join(map(clean, texts)) + END_DOC
        ids = np.fromiter(map(words.__getitem__, TOKEN.findall(joined)), dtype=np.int64)
        size = np.int64(len(words.short) + words.fixed + 8)  # more than any number; the same for one word list
        doc_end, sentence_end = ids == words[END_DOC], ids == words[END_SENTENCE]
        doc = np.cumsum(doc_end) - doc_end
        new = np.concatenate(([True], (doc_end | sentence_end)[:-1]))
        sentence = np.cumsum(new) - 1
        word = ~(doc_end | sentence_end)
        starts = np.flatnonzero(new)
        of_doc = doc[starts]
        s, w = sentence[word], ids[word]
        one = (s[1:] == s[:-1]) if len(s) > 1 else np.zeros(0, bool)
        two = (s[2:] == s[:-2]) if len(s) > 2 else np.zeros(0, bool)
        keys = np.concatenate((w, (size + w[:-1] * size + w[1:])[one] if len(s) > 1 else [], (size * size + size + w[:-2] * size + w[2:])[two] if len(s) > 2 else [])).astype(np.int64)
        where = np.concatenate((s, s[1:][one] if len(s) > 1 else [], s[2:][two] if len(s) > 2 else [])).astype(np.int64)
        return where, keys, of_doc, starts, np.append(starts[1:], len(ids))

    def sentence_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each sentence, and the document it belongs to."""
        where, keys, of_doc, _, _ = self._features(self.words, texts)
        if len(self.keys) == 0:
            return np.full(len(of_doc), 1 / (1 + np.exp(-self.bias))), of_doc
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        z = self.bias + np.bincount(where[hit], self.weights[at[hit]], minlength=len(of_doc))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), of_doc

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Noisy-or of each document, its worst sentence (0-based) and that one's score."""
        n = len(texts)
        if n == 0:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        p, doc = self.sentence_scores(texts)
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)[:n]
        first = np.searchsorted(doc, np.arange(n))
        worst = np.maximum.reduceat(p, first)
        hit = np.flatnonzero(p == worst[doc])
        at = hit[np.searchsorted(doc[hit], np.arange(n))] - first
        return 1 - np.exp(none), at, worst

    # ---- fitting
    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 80, rate: float = 0.5, sparse: float = 0.7, seed: int = 1) -> Model:
        """Maximum likelihood of the document labels (0 to 1) under noisy-or, with an L1 penalty.

        ``weights``: how many documents each one of the sample stands for, 1 by default.
        The penalty is in units of documents: a feature that mistaken labels alone
        support keeps weight 0.  The threshold is taken on held-out fifths.
        """
        if not texts:
            return cls(Words([END_DOC, END_SENTENCE, UNKNOWN, MASKED]), np.zeros(0, np.int64), np.zeros(0), -30.0, 0.5)
        specials = [END_DOC, END_SENTENCE, UNKNOWN, MASKED, QUOTE_OPEN, QUOTE_CLOSE, QUOTE]
        counts = Counter(t for x in texts for t in set(TOKEN.findall(clean(x))))
        known = [w for w, n in counts.items() if n >= KNOWN_DOCS and "*" not in w and w not in specials and w not in (".", "!", "?", "“", "”", "„", "‘")]
        words = Words(specials + sorted(known))
        where, keys, of_doc, _, _ = cls._features(words, texts)
        # features that few documents have are left out
        _, flat = np.unique(keys, return_inverse=True)
        pairs = np.unique(flat.astype(np.int64) * len(texts) + of_doc[where])
        spread = np.bincount(pairs // len(texts), minlength=flat.max(initial=0) + 1)
        kept = spread[flat] >= LEAST_DOCS
        vocabulary, feature = np.unique(keys[kept], return_inverse=True)
        sentence = where[kept]
        y = np.clip(np.asarray(labels, float), 0.015, 0.97)  # raters err
        share = np.ones(len(texts)) if weights is None else np.asarray(weights, float)

        def train(docs: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
            """Features are chosen under the penalty, then fitted again under a tenth of it."""
            w, bias = descend(docs, epochs, sparse, np.zeros(len(vocabulary)), -4.0, np.ones(len(feature), bool))
            chosen = w != 0
            return descend(docs, epochs, sparse / 10, w, bias, chosen[feature])

        def descend(docs: np.ndarray, epochs: int, penalty: float, w: np.ndarray, bias: float, usable: np.ndarray) -> tuple[np.ndarray, float]:
            use = docs[of_doc]
            renumber = np.cumsum(use) - 1
            keep = use[sentence] & usable
            f, s = feature[keep], renumber[sentence[keep]]
            d = (np.cumsum(docs) - 1)[of_doc[use]]
            t, stands = y[docs], share[docs]
            n_sentences, n_docs = int(use.sum()), int(docs.sum())
            w = w.copy()
            sw, sb = np.full(len(vocabulary), 1.0), 1.0
            for _ in range(epochs):
                p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(s, w[f], minlength=n_sentences), -30, 30)))
                none = np.exp(np.bincount(d, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n_docs))
                some = np.maximum(1 - none, 1e-9)
                g = p * (stands * ((1 - t) - t * none / some))[d]
                gw = np.bincount(f, g[s], minlength=len(w))
                gb = g.sum()
                sw += gw * gw
                sb += gb * gb
                pace = rate / np.sqrt(sw)
                w -= pace * gw
                w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
                bias -= rate * gb / np.sqrt(sb)
            return w, float(bias)

        fold = np.random.default_rng(seed).integers(0, 5, len(texts))
        held = np.zeros(len(texts))
        for k in range(2):  # two held-out fifths are enough to place a threshold
            w, b = train(fold != k, epochs // 2)
            part = [t for t, x in zip(texts, fold == k, strict=True) if x]
            held[fold == k] = cls(words, vocabulary, w, b, 0.5).score(part)[0]
        seen = fold < 2
        threshold = best_threshold(held[seen], np.asarray(labels)[seen] >= 0.5, share[seen])
        w, b = train(np.ones(len(texts), bool), epochs)
        used = np.abs(w) > 1e-4
        return cls(words, vocabulary[used], w[used].astype(np.float64), b, threshold)


def best_threshold(scores: np.ndarray, truth: np.ndarray, share: np.ndarray) -> float:
    """Score from 0.2 to 0.8 with the best weighted F1, nearest to 0.5 among equals."""
    best = (-1.0, 0.0, 0.5)
    for t in np.arange(0.2, 0.81, 0.05):
        hit = scores >= t
        f1 = 2 * share[hit & truth].sum() / max(1.0, share[hit].sum() + share[truth].sum())
        best = max(best, (round(float(f1), 4), -abs(float(t) - 0.5), float(t)))
    return best[2]
