"""Text that was read in another encoding than it was written in: find it and restore it.

A multinomial model over hashed byte bigrams, trained on synthetically garbled records, proposes the chain of encodings
of each stretch; the chain is inverted, and only a strict decoding into plausible text counts.
"""

from __future__ import annotations

import codecs
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and marks of the five languages of the texts, by language, and signs common in all.
LETTERS = {"pl": "ąćęłńóśźż", "en": "ï", "de": "äöüß", "fr": "àâæçèéêëîïôœùûüÿ", "es": "áéíñóúü"}
SIGNS = "„“”‚‘’«»–—…§°€ ¿¡"
#: Encodings of one byte a character that text is written in, and that it is read in.
WRITTEN = ("cp1250", "iso8859-2", "cp852", "cp1252", "mac_roman", "mac_latin2", "cp437", "cp850")
READ = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp852", "cp437", "mac_roman", "cp850", "mac_latin2")

BUCKETS = 8192
#: Bounds of the training sample: documents and characters of one document.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 8000
WINDOW_TOKENS = 60
LEAST_GAIN = 4.0
TRIED_CHAINS = 8

CLEAN = frozenset("".join(LETTERS.values())) | frozenset("".join(LETTERS.values()).upper().replace("SS", "")) | frozenset(SIGNS)
_BLANK = re.compile(r"([ \t\r\n]+)")
_ENDS = re.compile(r"[.?!][\"”»)\]]*$")
_POLISH = "".join(LETTERS["pl"]) + LETTERS["pl"].upper() + "„”–—…"
_SUSPECT = re.compile(f"[^\x00-\x7f{_POLISH}]")
_ODD = re.compile("[^\x00-\x7f" + "".join(map(re.escape, sorted(CLEAN))) + "]")
_FOREIGN = {lang: re.compile(f"[^\x00-\x7f{x}{x.upper()}{SIGNS}]") for lang, x in LETTERS.items()}
_CONTROL = re.compile(r"[^\W\d_][\x80-\x9f]|[\x80-\x9f][^\W\d_]")
_REPLACED = re.compile(r"[^\W_]�|�[^\W_]")


@cache
def _tables(codec: str) -> tuple[str, object]:
    """Decoding table and encoding map; bytes without a character stand for the control character of the same number."""
    forth = []
    for i in range(256):
        try:
            forth.append(bytes([i]).decode(codec))
        except UnicodeDecodeError:
            forth.append(chr(i))
    table = "".join(forth)
    return table, codecs.charmap_build(table)


def misread(raw: bytes, codec: str) -> str:
    return codecs.charmap_decode(raw, "strict", _tables(codec)[0])[0]


def unread(text: str, codec: str) -> bytes | None:
    """The bytes that were read as ``text``; None where a character has none."""
    try:
        return codecs.charmap_encode(text, "strict", _tables(codec)[1])[0]
    except UnicodeEncodeError:
        return None


def chains() -> list[tuple[str, str, int]]:
    """(written, read, times) of every chain the model knows."""
    wide = [("utf-8", r, n) for n in (1, 2) for r in READ]
    return wide + [(w, r, 1) for w in WRITTEN for r in READ if w != r]


def garble(text: str, chain: tuple[str, str, int]) -> str | None:
    """``text`` as it looks after the chain; None where it can't be written in the first encoding."""
    written, read, times = chain
    for _ in range(times):
        if written == "utf-8":
            text = misread(text.encode(), read)
        else:
            raw = unread(text, written)
            if raw is None:
                return None
            text = misread(raw, read)
    return text


def restore(text: str, chain: tuple[str, str, int]) -> str | None:
    """Inverse of ``garble``, strict: None where the text can't have come about by this chain."""
    written, read, times = chain
    for _ in range(times):
        raw = unread(text, read)
        if raw is None:
            return None
        if written == "utf-8":
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            text = misread(raw, written)
    return text


def _bigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if raw.size < 2:
        return np.zeros(0, np.int64)
    pair = raw[:-1] * np.uint32(256) + raw[1:]
    return ((pair * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)  # the top 13 bits: 8192 buckets


def _total(by_bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows ``at``; of a very long word by counts, so that memory doesn't grow with it."""
    if at.size <= 2048:
        return by_bucket[at].sum(0)
    return np.bincount(at, minlength=len(by_bucket)).astype(np.float32) @ by_bucket


def windows(tokens: list[str]):
    """Ranges of ``tokens`` (words at even places, blanks at odd ones): sentences or lines, of at most 60 words."""
    start = 0
    for i in range(0, len(tokens), 2):
        last = i + 1 >= len(tokens)
        if last or "\n" in tokens[i + 1] or _ENDS.search(tokens[i]) or i - start >= 2 * WINDOW_TOKENS:
            yield start, i + 1
            start = i + 2


class ChainModel:
    """Multinomial (naive Bayes) model of (language, chain) classes over hashed byte bigrams; chain 0 is no chain."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.chains = langs, chains()
        self.width = len(self.chains) + 1
        # class = language * (chains + 1) + chain
        self.by_bucket = np.ascontiguousarray(logp.T)
        self.clean_by_bucket = np.ascontiguousarray(logp[:: self.width].T)

    @classmethod
    def train(cls, texts: list[tuple[str, str]]) -> ChainModel:
        """``texts``: (language, clean text)."""
        known = chains()
        langs = sorted({lang for lang, _ in texts}) or ["pl"]
        counts = np.zeros((len(langs) * (len(known) + 1), BUCKETS), np.float32)
        for lang, text in texts:
            base = langs.index(lang) * (len(known) + 1)
            counts[base] += np.bincount(_bigrams(f" {text} "), minlength=BUCKETS)
        # garbling acts on each character by itself: each language is garbled as one text, without the words that the
        # first encoding can't write
        for i, lang in enumerate(langs):
            whole = " ".join(text for own, text in texts if own == lang)
            words = whole.split(" ")
            for j, chain in enumerate(known):
                usable = whole if chain[0] == "utf-8" else " ".join(w for w in words if w.isascii() or unread(w, chain[0]) is not None)
                counts[i * (len(known) + 1) + j + 1] = np.bincount(_bigrams(garble(usable, chain)), minlength=BUCKETS)
        counts += 0.05
        return cls(langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))

    def scores(self, text: str) -> np.ndarray:
        return _total(self.by_bucket, _bigrams(f" {text} ")).reshape(len(self.langs), self.width)

    def clean_score(self, text: str) -> tuple[float, str]:
        """Log probability as clean text of the likeliest language, and that language."""
        each = _total(self.clean_by_bucket, _bigrams(f" {text} "))
        return float(each.max()), self.langs[int(each.argmax())]

    def order(self, text: str) -> list[int]:
        """Chains (numbers from 0; -1 is none) in order of their probability, over all languages."""
        return [int(i) - 1 for i in np.argsort(-self.scores(text).max(0), kind="stable")]


def _plausible(before: str, after: str) -> bool:
    """Of a one-byte chain: some letter is as it was; a restored letter stands beside letters and not beside a digit, and
    no capital follows a small letter; what was a letter doesn't become a sign within a word."""
    if not any(a == b and b.isalpha() for a, b in zip(before, after)):
        return False
    for i, (a, b) in enumerate(zip(before, after)):
        if a == b:
            continue
        left, right = after[max(0, i - 1) : i], after[i + 1 : i + 2]
        if b.isalpha():
            if not (left.isalpha() or right.isalpha() or left == "’") or left.isdigit() or right.isdigit() or (b.isupper() and left.islower()):
                return False
        elif left.isalpha() and right.isalpha() and b != "’":
            return False
    return True


def _invert_words(words: list[str], chain: tuple[str, str, int]) -> list[str] | None:
    """The words with those inverted that the chain explains; None where it explains none.

    Odd words that a one-byte chain can't explain stay as they are: odd signs, and characters that its encoding doesn't have, stand
    in fine text. Then a sign that becomes the last letter of a word (``m³``) proves nothing. An odd letter that it has speaks against the chain."""
    out, changed, left, proved = [], 0, False, False
    for w in words:
        back = None if w.isascii() or not _SUSPECT.search(w) and chain[0] == "utf-8" else restore(w, chain)
        if back is not None and back != w and not any(ord(c) < 32 or 127 <= ord(c) < 160 for c in back):
            if chain[0] == "utf-8" or not _ODD.search(back) and _plausible(w, back):
                out.append(back)
                changed += 1
                proved = proved or any(a != b and b.isalpha() and (a.isalpha() or w[i + 1 : i + 2].isalpha()) for i, (a, b) in enumerate(zip(w, back)))
                continue
            if not any(c.isalnum() for c in back) and not _ODD.search(back):  # a sign by itself goes along, but proves nothing
                out.append(back)
                continue
        if chain[0] != "utf-8" and _ODD.search(w):
            if any(c.isalpha() and _ODD.match(c) and unread(c, chain[1]) is not None for c in w):
                return None
            left = True
        out.append(w)
    return out if changed and (proved or not left) else None


def _foreign(before: list[str], after: list[str], lang: str, own: str, model: ChainModel) -> bool:
    """Whether words with characters foreign to the language were restored, and no such character is left in them.

    Polish letters are foreign to other languages too, but all texts cite Polish words: where only these change, the changed
    words must be likelier by themselves, each in its likeliest language, Polish included, and ``lang`` the text's ``own``."""
    usual = set(LETTERS[lang] + SIGNS)
    strange = lambda w, known: any(not c.isascii() and c.lower() not in known for c in w)
    changed = [(a, b) for a, b in zip(before, after) if a != b]
    cited = usual | set(LETTERS["pl"])
    if any(strange(b, cited) for _, b in changed):
        return False
    if any(strange(a, cited) for a, _ in changed):
        return True
    if lang != own or any(strange(b, usual) for _, b in changed) or not any(strange(a, usual) for a, _ in changed):
        return False
    return sum(model.clean_score(b)[0] - model.clean_score(a)[0] for a, b in dict.fromkeys(changed)) >= LEAST_GAIN


def _broken_leads(words: list[str], codec: str) -> bool:
    """Characters that are lead bytes of UTF-8 read in ``codec``, right after a lower-case letter: bytes got lost."""
    leads = {misread(bytes([b]), codec) for b in (0xC3, 0xC4, 0xC5)}
    return any(b in leads and a.islower() and (a.isascii() or a not in leads) and b.isupper() for w in words for a, b in zip(w, w[1:]))


def examine(text: str, model: ChainModel, lang: str | None = None) -> tuple[str | None, bool, str] | None:
    """(chain, restorable, restored text) of a garbled text, else None. ``chain`` names all that were found.

    Polish letters are above suspicion only in a text of which ``lang``, or where that is unknown the model, says that it is Polish."""
    if text.isascii():
        return None
    if lang not in LETTERS:
        lang = model.clean_score(text)[1]
    suspect = _SUSPECT if lang == "pl" else _FOREIGN[lang]
    if not suspect.search(text):
        return None
    tokens = _BLANK.split(text)
    named: list[str] = []
    lost = False
    # windows and what chains restore them to, with the gain; most windows leave few chains apart, the document settles it
    options: list[tuple[int, int, dict[tuple[str, str, int], tuple[float, list[str]]]]] = []
    for a, b in windows(tokens):
        words = tokens[a:b:2]
        whole = " ".join(words)
        if not suspect.search(whole):
            continue
        if "�" in whole and _REPLACED.search(whole):
            lost = True
            named.append("replaced")
            continue
        odd = _ODD.search(whole)
        tried = model.order(" ".join(w for w in words if not w.isascii()) if len(words) > 8 else whole)
        if tried[0] < 0 and not odd and lang == "pl":
            continue
        top = model.chains[tried[0]] if tried[0] >= 0 else None
        broken = top is not None and top[0] == "utf-8" and _broken_leads(words, top[1])
        torn = _CONTROL.search(whole) is not None
        fits = {}
        before, _ = model.clean_score(whole)
        for rank, c in enumerate(x for x in tried if x >= 0):
            chain = model.chains[c]
            if rank >= TRIED_CHAINS and (fits or not odd) or (broken and chain[0] != "utf-8"):
                continue
            back = _invert_words(words, chain)
            if back is None:
                continue
            after, likely = model.clean_score(" ".join(back))
            # of chains that are unlikely by themselves only those count that lead to the text's own language
            if after - before >= LEAST_GAIN and (chain[0] == "utf-8" or (rank < TRIED_CHAINS or likely == lang) and _foreign(words, back, likely, lang, model)):
                fits[chain] = after - before, back
        if fits:
            options.append((a, b, fits))
        if broken and (not fits or any(_ODD.search(w) for w in max(fits.values())[1])):
            lost = True
            named.append("lossy {}>{}".format(*top[:2]))
        elif torn and not fits:
            lost = True
            named.append("unknown")
    total: dict[tuple[str, str, int], float] = {}
    for _, _, fits in options:
        for chain, (gain, _) in fits.items():
            total[chain] = total.get(chain, 0.0) + gain
    for a, b, fits in options:
        chain = max((c for c, (gain, _) in fits.items() if gain >= 0.7 * max(g for g, _ in fits.values())), key=lambda c: (total[c], c))
        named.append("{}>{}x{}".format(*chain))
        tokens[a:b:2] = fits[chain][1]
    return (",".join(dict.fromkeys(named)), not lost, "".join(tokens)) if named else None


def train_chain_model(df: DataFrame, text: str, lang: str, sample_docs: int = SAMPLE_DOCS) -> ChainModel:
    """Fit the model on a bounded sample: at most ``sample_docs`` documents, of up to 8000 characters each, whose language
    is known and whose characters all belong to the five languages."""
    total = df.count()
    every = max(1, total // (2 * sample_docs))
    usual = "^[\\x00-\\x7f" + "".join(sorted(CLEAN)) + "]*$"
    picked = df.where((F.pmod(F.xxhash64(text), F.lit(every)) == 0) & F.col(lang).isin(*LETTERS) & F.col(text).rlike(usual) & (F.length(text) <= SAMPLE_CHARS))
    rows = picked.orderBy(F.xxhash64(text), lang).select(lang, text).limit(sample_docs).collect()
    return ChainModel.train([(r[0], r[1]) for r in rows])


def find_garbled(df: DataFrame, key: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Documents whose text, or a stretch of it, was read in another encoding than it was written in.

    Columns: ``key``, ``chain`` (the chains found, written>read and how often; ``replaced`` where characters were lost to
    U+FFFD; ``lossy`` where bytes were dropped; ``unknown`` for control characters within words that no chain explains), ``restorable`` and ``restored`` (the text with all stretches restored
    that can be). Null, empty and blank texts are never garbled; each row is judged by itself, repeated rows included; the whole
    text is read, however long, in windows of a sentence. Other columns are ignored.
    """
    model = df.sparkSession.sparkContext.broadcast(train_chain_model(df, text, lang, sample_docs))

    def run(batches):
        for batch in batches:
            out = []
            for k, t, own in zip(*[c.to_pylist() for c in batch.columns]):
                if t and not t.isascii() and (x := examine(t, model.value, own)):
                    out.append((k, *x))
            if out:
                kinds = [batch.schema.field(0).type, pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "chain", "restorable", "restored"])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(run, f"key {kind}, chain string, restorable boolean, restored string")
    return found.withColumnRenamed("key", key)
