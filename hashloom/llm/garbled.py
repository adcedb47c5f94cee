"""Garbled text from wrong character encoding: description length under per-language zstandard dictionaries.

A wrong decoding is undone by a chain of steps, each of which writes the text in the charset it was wrongly read with and reads the
bytes in the charset they were in. Every word beyond ASCII is described as it stands and in each decoding that is possible without
error. The description of a word is the shorter one of its zstandard compression and of its number in a table of the words known
from all texts, longer by a fixed cost for each character foreign to the language. Words whose decoding is shorter are tried in
their line: per line and chain the line is compressed as it stands and as restored, and what the chain saves, less its own cost,
decides; without a saving the line stays as it is.

Bytes can always be read in another single-byte charset, so such a chain must give more than a shorter line: the characters of a
known word cost nothing extra, however rare; on the page the chain must turn a character foreign to all languages into an ordinary
one, or a word into one known far better; and it turns no ordinary letter within a word into a sign, and mixes no cases.

U+FFFD and the control characters U+0080 to U+009F are made by wrong decodings only. What stands for them is lost; the chain ``lost``
describes each as one unknown character, and is judged by length as the others are.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.session import checkpointed

#: Charsets a text is wrongly read with, and those its bytes may have been in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
WAS_SINGLE = "cp1252"
#: Names of languages as they are written in the column lang.
LANGUAGES = {"en": "en", "eng": "en", "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es"}
#: Documented bound of the sample the dictionaries are trained on, in pages (languages with few pages come on top), and the size of a dictionary in bytes.
SAMPLE_PAGES, DICTIONARY_BYTES = 4000, 64_000
#: Documented bound of the lines a dictionary of that size is trained on: of the sample's lines those with the lowest hash of their text.
DICTIONARY_LINES = 40_000
#: Documented bound of the known words: one that is less than this part of all words beyond ASCII, or stands once, counts as unknown.
KNOWN_WORDS = 500_000
#: A character is ordinary in a language if at least this share of the language's lines with any character beyond ASCII have it.
ORDINARY = 0.002
#: Bytes a foreign character costs beside its marker.
FOREIGN_COST = 3
#: Bytes a character costs that no language has.
NEVER_COST = 10
#: Cost of a chain's step in bytes: what isn't UTF-8 is hardly ever read as UTF-8 without error, single bytes always can be.
UTF8_COST, SINGLE_COST = 0.5, 2.5
#: How much more often than a word without letters the word it would become must be known; with letters, this makes it evidence.
SIGN_FACTOR = 20
#: A language code that isn't listed above has a dictionary of its own if at least one page in so many has it.
OWN_DICTIONARY = 64
LOST = "lost"

_NEVER = re.compile("[�\x80-\x9f]")
_DIGITS = re.compile(r"\d+")
#: A word with a character beyond ASCII. No-break and other special spaces may be parts of garbled characters, so they don't end it.
_TOKEN = re.compile(r"[^ \n\t\r]*[^\x00-\x7f][^ \n\t\r]*")


def _charset(name: str) -> dict[str, int]:
    """Character -> byte; bytes that the charset leaves open stand for the control character of that number, as most decoders do."""
    out = {}
    for b in range(256):
        try:
            out.setdefault(bytes([b]).decode(name), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


_BYTES = {c: _charset(c) for c in READ_AS}
_SINGLE = {b: c for c, b in _BYTES[WAS_SINGLE].items()}
#: Characters beyond ASCII that a restored text may have anywhere: letters of Western and Central European languages and typographic signs.
_FINE = re.compile(r"[\x00-\x7f\xa0-ſƒˆ˜‐-‧‰-›€№™]*")


def _lead(name: str) -> re.Pattern:
    """Finds what UTF-8 of two, three or four bytes looks like when read as ``name``."""
    chars = defaultdict(str)
    for c, b in _BYTES[name].items():
        kind = "tail" if 0x80 <= b <= 0xBF else 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else None
        chars[kind] += re.escape(c)
    return re.compile("|".join(f"[{chars[n]}][{chars['tail']}]{{{n}}}" for n in (1, 2, 3)))


_LEAD = {c: _lead(c) for c in READ_AS}
_TO_SINGLE = {c: str.maketrans({ch: _SINGLE[b] for ch, b in _BYTES[c].items() if b >= 0x80 and b in _SINGLE}) for c in READ_AS if c != WAS_SINGLE and c != "latin-1"}


def _one_script(word: str) -> bool:
    """True for at least two letters of one script and nothing else beyond ASCII, without ASCII letters: no chance result of a decoding."""
    own = [c for c in word if c > "\x7f"]
    return len(own) > 1 and all(c.isalpha() for c in own) and len({unicodedata.name(c, "?").split(" ")[0] for c in own}) == 1 and not re.search("[A-Za-z]", word)


def to_utf8(word: str, read_as: str) -> str | None:
    """``word`` written as ``read_as`` and read as UTF-8, or None where that can't be."""
    table = _BYTES[read_as]
    try:
        out = bytes([table[c] for c in word]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return out if out != word else None


def plausible(word: str) -> bool:
    """False for a result with characters that only a wrong decoding, or chance, may have put together."""
    return bool(_FINE.fullmatch(word) or _one_script(word)) and not _NEVER.search(word)


def to_single(word: str, read_as: str) -> str | None:
    """``word`` written as ``read_as`` and read as Windows-1252, or None."""
    out = word.translate(_TO_SINGLE[read_as])
    if out == word or any(ord(c) > 127 and c not in _BYTES[read_as] for c in word):
        return None
    return out if _FINE.fullmatch(out) and not _NEVER.search(out) else None


_FOREIGN = b"\x1b"
codecs.register_error("hashloom-foreign", lambda e: (_FOREIGN * (e.end - e.start), e.end))


class Alphabet:
    """Writes a text with one byte per character: those beyond ASCII that are ordinary in a language have a byte each.

    Any other character is foreign: one marker byte, and FOREIGN_COST bytes more in a description. So a description's length follows
    how usual a character is in the language, not how long its UTF-8 happens to be. A byte has room for the 127 most usual ones; more
    than that cost as much as foreign ones here, and still count as ordinary elsewhere.
    """

    def __init__(self, ordinary: str):
        ordinary = ordinary[:127]
        free = (chr(0xE000 + i) for i in range(256))
        table = [chr(i) if i != _FOREIGN[0] else next(free) for i in range(128)] + [*ordinary] + [next(free) for _ in range(128 - len(ordinary))]
        self.table = codecs.charmap_build("".join(table))

    def encode(self, text: str) -> bytes:
        return codecs.charmap_encode(text, "hashloom-foreign", self.table)[0]


@dataclass
class Model:
    """Dictionaries of a bounded sample, known words and characters of all texts; small enough to be sent to every worker."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    alphabets: dict[str, str] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    total: int = 0  # of all words beyond ASCII
    own_codes: tuple[str, ...] = ()

    def sizes(self) -> dict[str, Callable[[str], int]]:
        """By language: the bytes a text takes."""
        how = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)

        def size(lang: str, dictionary: bytes) -> Callable[[str], int]:
            encode, known = Alphabet(self.alphabets.get(lang, "")).encode, zstandard.ZstdCompressionDict(dictionary)
            known.precompute_compress(compression_params=how)
            compress = zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress
            return lambda text: len(compress(b := encode(text))) + FOREIGN_COST * b.count(_FOREIGN)

        return {k: size(k, v) for k, v in self.dictionaries.items()}


def _perhaps() -> re.Pattern:
    """One quick pattern that finds whatever ``suspicious`` may find, and more."""
    kinds = [("".join(re.escape(c) for c, b in t.items() if low <= b <= high)) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)) for n, t in _BYTES.items() if n != "mac_roman"]
    half = len(kinds) // 2
    return re.compile(f"[\ufffd\x80-\x9f]|[{''.join(kinds[:half])}][{''.join(kinds[half:])}]")


_PERHAPS = _perhaps()


def suspicious(text: str) -> bool:
    """True if the text has characters that only wrong decodings make, or looks like UTF-8 read in another charset."""
    return bool(_PERHAPS.search(text)) and (bool(_NEVER.search(text)) or any(p.search(text) for c, p in _LEAD.items() if c != "mac_roman"))


def counted(texts: Iterable[tuple[str | None, str | None]], own: Container[str] = ()) -> Counter:
    """(kind, language, key) -> n over the lines of ``texts`` (text, language) with a character beyond ASCII and no suspicious one.

    Kinds are line, char (lines with the character) and word (of all languages together). ``own``: codes with a dictionary of their own.
    """
    out, words, chars_of = Counter(), Counter(), defaultdict(Counter)
    for text, lang in texts:
        if not text or text.isascii():
            continue
        name = _language(lang, own)
        lines, chars = 0, chars_of[name]
        for line in text.split("\n"):
            if not line.isascii() and not suspicious(line):
                lines += 1
                words.update(map(_shape, _TOKEN.findall(line)))
                chars.update(c for c in {*line} if c > "\x7f")
        if lines:
            out["line", name, ""] += lines
    out.update({("word", "", w): n for w, n in words.items()})
    out.update({("char", name, c): n for name, chars in chars_of.items() for c, n in chars.items()})
    return out


def _language(lang: str | None, own: Container[str] = ()) -> str:
    code = (lang or "").lower()
    return LANGUAGES.get(code) or (code if code in own else "other")


def train(sample: list[tuple[str, str | None]], size: int = DICTIONARY_BYTES, counts: dict | None = None, own_codes: Container[str] = ()) -> Model:
    """Dictionaries of the lines of ``sample`` (text, language) without suspicious characters; words and characters from ``counts`` or the sample.

    A language with too few lines for training gets its lines as they are; without any text there is one empty dictionary.
    """
    counts = counted(sample, own_codes) if counts is None else counts
    lines, chars = defaultdict(list), defaultdict(dict)
    for text, lang in sample:
        name = _language(lang, own_codes)
        for line in (text or "").split("\n"):
            if line and (line.isascii() or not suspicious(line)):
                lines[name].append(line)
    for (kind, name, key), n in counts.items():
        if kind == "char":
            chars[name][key] = n
    words = {key: n for (kind, _, key), n in counts.items() if kind == "word" and n > 1}
    model = Model(words=words, total=counts.get(("words", "", ""), sum(words.values())))
    for name, own in lines.items():
        if name == "other" and len(lines) > 1:
            continue
        marked = counts.get(("line", name, ""), 0)
        usual = [c for c, n in sorted(chars[name].items(), key=lambda x: (-x[1], x[0])) if n >= max(2, ORDINARY * marked)]
        model.alphabets[name] = "".join(dict.fromkeys([*usual, *(x for c in usual for x in (c.upper(), c.lower()) if len(x) == 1 and x > "\x7f")]))
        encode = Alphabet(model.alphabets[name]).encode
        chosen = sorted(own, key=lambda x: (blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), x))
        encoded = [encode(x) for x in chosen[: int(DICTIONARY_LINES * size / DICTIONARY_BYTES)]]
        try:
            model.dictionaries[name] = zstandard.train_dictionary(size, encoded, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            model.dictionaries[name] = b"\n".join(encoded)[-size:]
    model.dictionaries = model.dictionaries or {"en": b""}
    return model


def _shape(word: str) -> str:
    """The word with each run of digits as one 0."""
    return word if word.isalpha() else _DIGITS.sub("0", word)


def _cost(chain: str) -> float:
    return sum(SINGLE_COST if step.endswith(f">{WAS_SINGLE}") else UTF8_COST for step in chain.split(" "))


#: Signs that open or close what they stand at.
_OPENING, _CLOSING = "\u201e\u00ab\u00bf\u00a1", "\u201d\u00bb"


def _odd_sign(word: str, i: int, r: str, ordinary: set[str]) -> bool:
    """True where the character at ``i`` would become a sign that can't stand there: turned the wrong way, or for an ordinary letter within a word."""
    if len(word) > 1 and ((r in _OPENING and i == len(word) - 1) or (r in _CLOSING and i == 0)):
        return True
    if r in "\u2013\u2014" and word[i].isalpha() and ((i == len(word) - 1 and word[i - 1 : i].isalnum()) or (i == 0 and word[1:2].isalnum())):
        return True
    within = 0 < i < len(word) - 1 and word[i - 1].isalnum() and word[i + 1].isalnum()
    return within and word[i] in ordinary and word[i].isalpha() and not r.isalnum() and r != "\u2019"


def _mixes_cases(word: str, r: str) -> bool:
    """True where a changed character is the only one of its case among the letters after the first."""
    rest = [(a, b) for a, b in zip(word[1:], r[1:]) if b.isalpha()]
    kept = [b for a, b in rest if a == b]
    new = [b for a, b in zip(word, r) if a != b and b.isalpha()]
    return bool(kept) and (all(b.isupper() for b in kept) and any(b.islower() and b.upper() != b for b in new) or all(b.islower() for b in kept) and any(b.isupper() for a, b in rest if a != b))


class Restorer:
    """Applies a model to texts, one at a time."""

    def __init__(self, model: Model):
        self.known, self.total, self.by_lang, self.own_codes = model.words, max(2, model.total), model.sizes(), model.own_codes
        self.empty = {k: size("") for k, size in self.by_lang.items()}
        self.ordinary = {k: set(model.alphabets.get(k, "")) for k in self.by_lang}
        self.anywhere = set().union(*self.ordinary.values())
        self.cache: dict[str, list[tuple[str, str, dict[str, float]]]] = {}

    def price(self, w: str, lang: str, foreign_cost: float = FOREIGN_COST) -> float:
        """The bytes that describe a word: compressed, or as a number in the table of known words."""
        size, n = self.by_lang[lang](w) - self.empty[lang], self._known(w)
        if not n:
            return size
        return min(size, math.log2(self.total / n + 1) / 8 + foreign_cost * sum(c > "\x7f" and c not in self.ordinary[lang] for c in w))

    def word(self, w: str) -> list[tuple[str, str, dict[str, float]]]:
        """(chain, result, bytes saved by language) of each decoding that some language describes in fewer bytes."""
        found = self.cache.get(w)
        if found is None:
            if len(self.cache) > 200_000:  # bounded memory: a dropped word is only worked out again
                self.cache.clear()
            found, prices = [], {}
            for chain, r in self._decodings(w):
                cost = FOREIGN_COST if chain.endswith(">utf-8") else 0
                now = prices.get(cost) or prices.setdefault(cost, {k: self.price(w, k, cost) for k in self.by_lang})
                saved = {k: x for k in self.by_lang if (x := now[k] - self.price(r, k)) > 0}
                if saved:
                    found.append((chain, r, saved))
            self.cache[w] = found
        return found

    def _decodings(self, w: str) -> Iterator[tuple[str, str]]:
        """(chain, result). What can be read as UTF-8 isn't read as single bytes."""
        utf8 = False
        for c in READ_AS:
            if not _LEAD[c].search(w):
                continue
            chain, now = "", w
            while True:  # each step makes the word shorter
                steps = [(f"{d}>utf-8", r) for d in ([c] if not chain else READ_AS) if _LEAD[d].search(now) and (r := to_utf8(now, d))]
                if not steps:
                    break
                step, now = next((x for x in steps if plausible(x[1])), steps[0])
                chain = f"{chain} {step}".strip()
                if plausible(now):
                    utf8 = True
                    yield chain, now
        if not utf8:
            letters = re.search("[A-Za-z]", w) is not None
            for c in _TO_SINGLE:
                if (r := to_single(w, c)) and (letters or self._known(r) > SIGN_FACTOR * self._known(w)):
                    yield f"{c}>{WAS_SINGLE}", r

    def _known(self, w: str) -> int:
        return self.known.get(_shape(w), 0)

    def _single(self, w: str, r: str, lang: str) -> bool | None:
        """Whether a single-byte reading may be used: None if not, True if it is evidence by itself."""
        ordinary, strong = self.ordinary[lang], self._known(r) > SIGN_FACTOR * max(1, self._known(w))
        for i, (a, b) in enumerate(zip(w, r)):
            if b > "\x7f" and b not in ordinary:
                return None
            if a != b:
                if _odd_sign(w, i, b, ordinary):
                    return None
                strong |= a not in self.anywhere
        return None if _mixes_cases(w, r) else strong

    def usable(self, chain: str, own: dict[int, dict[str, tuple[str, dict[str, float]]]], lang: str) -> dict[int, dict[str, str]]:
        """By line, the words that ``chain`` changes in this language.

        Words of a single-byte chain that are no evidence by themselves are changed only between lines that have some.
        """
        shorter = {i: {w: r for w, (r, saved) in to.items() if lang in saved} for i, to in own.items()}
        if chain.endswith(">utf-8"):
            return {i: to for i, to in shorter.items() if to}
        kind = {i: {w: self._single(w, r, lang) for w, r in to.items()} for i, to in shorter.items()}
        strong = [i for i, k in kind.items() if any(k.values())]
        if not strong:
            return {}
        return {i: use for i, to in shorter.items() if min(strong) <= i <= max(strong) and (use := {w: r for w, r in to.items() if kind[i][w] is not None})}

    def restore(self, text: str | None, lang: str | None = None) -> tuple[bool, str | None, list[str]]:
        """(garbled, restored text, chains used). Null and plain ASCII texts are never garbled."""
        if not text or text.isascii():
            return False, text, []
        lines = text.split("\n")
        tries: dict[str, dict[int, dict[str, tuple[str, dict[str, float]]]]] = defaultdict(dict)  # by chain and line, the words it changes
        lost = [i for i, line in enumerate(lines) if _NEVER.search(line)]
        for i, line in enumerate(lines):
            if line.isascii():
                continue
            for w in _TOKEN.findall(line):
                for chain, r, saved in self.word(w):
                    tries[chain].setdefault(i, {})[w] = r, saved
        if not tries and not lost:
            return False, text, []
        name = _language(lang, self.own_codes)
        at = sorted({*lost, *(i for t in tries.values() for i in t)})
        plain = {k: [size(lines[i]) for i in at] for k, size in self.by_lang.items()}
        best = min(plain, key=lambda k: (sum(plain[k]) - (4 if k == name else 0), k))
        size, old = self.by_lang[best], dict(zip(at, plain[best]))
        made = {chain: {i: _TOKEN.sub(lambda m, to=to: to.get(m.group(), m.group()), lines[i]) for i, to in self.usable(chain, own, best).items()} for chain, own in tries.items()}
        gains = {chain: {i: g for i, new in own.items() if (g := old[i] - size(new)) > _cost(chain)} for chain, own in made.items()}
        used, out, left = [], list(lines), set(old)
        while gains and left and (chain := max(gains, key=lambda c: (sum(g for i, g in gains[c].items() if i in left), -_cost(c), c))):
            own = {i for i in gains[chain] if i in left}
            if not own:
                break
            used.append(chain)
            for i in own:
                out[i] = made[chain][i]
            left -= own
        if any(size(line) + (NEVER_COST - FOREIGN_COST - 1) * n - size(_NEVER.sub("", line)) > _cost(LOST) for line in (out[i] for i in lost) if (n := len(_NEVER.findall(line)))):
            used.append(LOST)
        return bool(used), "\n".join(out), used


def _name(own: tuple[str, ...]):
    """The language of a row as ``_language`` gives it, as a column."""
    known = {**{c: c for c in own}, **LANGUAGES}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(names[F.lower("lang")], F.lit("other"))


def own_codes(documents: DataFrame) -> tuple[str, ...]:
    """Language codes beside the listed ones that at least one page in OWN_DICTIONARY has, so at most as many."""
    counts = documents.select(F.lower("lang").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    many = counts.where(F.col("n") * OWN_DICTIONARY >= counts.agg(F.sum("n")).scalar()).where(F.col("code").isNotNull() & ~F.col("code").isin(*LANGUAGES))
    return tuple(sorted(r["code"] for r in many.collect()))


def corpus_counts(documents: DataFrame, known: int = KNOWN_WORDS, own: tuple[str, ...] = ()) -> dict[tuple[str, str, str], int]:
    """``counted`` over all documents; of the words those that stand at least twice and at least once in ``known``, so fewer than ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = counted(zip(b.column("text").to_pylist(), b.column("lang").to_pylist()), own)
            if found:
                kind, lang, key = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(lang), pa.array(key), pa.array([*found.values()], pa.int64())], names=["kind", "name", "key", "n"])

    each = documents.select("text", "lang").mapInArrow(run, "kind string, name string, key string, n bigint")
    counts = checkpointed(each.groupBy("kind", "name", "key").agg(F.sum("n").alias("n")))
    words = counts.where("kind = 'word'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    kept = counts.where((F.col("kind") != "word") | ((F.col("n") > 1) & (F.col("n") * F.lit(known) >= words)))
    return {("words", "", ""): words, **{(r["kind"], r["name"], r["key"]): r["n"] for r in kept.collect()}}


def sample_pages(documents: DataFrame, pages: int = SAMPLE_PAGES, own: tuple[str, ...] = ()) -> list[tuple[str, str | None]]:
    """About ``pages`` pages by the hash of their id and text, rows delivered again once, and a quarter of that of each language as far as it has them."""
    rows = documents.where("text is not null").select("doc_id", "text", "lang", _name(own).alias("name"))
    n = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language with a dictionary
    if not n:
        return []
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(max(pages / sum(n.values()), pages / 4 / v if k != "other" else 0.0)))])
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(u < share[F.col("name")]).select("doc_id", "text", "lang").distinct()
    return [(r["text"], r["lang"]) for r in chosen.collect()]


def model_of(documents: DataFrame) -> Model:
    """Words and characters of all documents, dictionaries of a sample; bounded by SAMPLE_PAGES, DICTIONARY_BYTES, KNOWN_WORDS, OWN_DICTIONARY."""
    own = own_codes(documents)
    model = train(sample_pages(documents, own=own), counts=corpus_counts(documents, own=own), own_codes=own)
    model.own_codes = own
    return model


def restored(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, garbled BOOLEAN, restored STRING, chains ARRAY<STRING>) for every row of ``documents`` (doc_id, text, lang).

    Null and empty texts are not garbled. ``restored`` is the text itself where nothing was to be gained. Rows with the same id
    each have their result.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model or model_of(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for b in batches:
            rows = [restorer.restore(t, lang) for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                names=["doc_id", "garbled", "restored", "chains"],
            )

    return documents.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, garbled boolean, restored string, chains array<string>")
