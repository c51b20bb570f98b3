"""Text cut off by field limits: find the documents that stop before their end, and how often each source truncates.

Every document is taken apart once: footers, cut marks and stray characters behind the text are put aside, and what
remains is read as tokens. Then

1. near-copies decide for every text that has one. Texts are collapsed to one per exact copy, min-hash signatures over
   shingles of five words are banded, and texts that share a bucket are aligned at their ends: a text A is held against
   the texts B of its buckets that hold A's five words before the last one, followed by a word that begins as A's last
   word does, and whose similarity with A is verified to be 0.8 or more. A is truncated if its alignment ends early, i.e.
   inside B's word or inside B's sentence; it is whole if a copy has a stop where A ends.
2. closing-word terminality decides for all others: how the corpus goes on after the document's closing words. Counted
   per source over all documents: contexts of one to three tokens (frequent words as they are, other tokens by their
   shape) and whether a stop, a line end, an ellipsis or more text followed. A text is whole if texts of its source
   really end, in the way it ends, behind such words; the longest context with enough support decides.

Scale: one cheap pass over the texts for the words, one for contexts and signatures (both combined in the task before
the shuffle), one over the texts that share a bucket. Words that count as frequent occur in a fixed share of the
documents, so their number has a proven bound (words per document / share). No bucket is paired out: partners are joined
on (bucket, closing words), in rounds of at most CHUNK partners a text, and a text leaves with its first verdict; the
rounds go on until every text has one or no partner is left, so none is lost. Contexts are known by 64-bit hashes.

Defined cases: null, empty and blank texts are whole; repeated texts count once in the statistics and get one answer;
texts are read whole, however long. Documents of a null source are a source of their own. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.session import bounded, written

#: A word is frequent if it occurs in this share of the texts, but in at least MIN_TEXTS.
SHARE, MIN_TEXTS = 0.002, 3
#: Occurrences a context must have besides the document's own, and the least share of them that end as the document does.
SUPPORT, TERMINAL = 4, 0.08
#: An ellipsis is a habit, not a mark, behind words with which at least SUPPORT texts of the source, and this share of
#: those that end in an ellipsis, end.
HABIT = 0.02
#: A frequent word that ends this share of its occurrences or more may be new in its place.
OFTEN = 0.3
#: Lines that end behind a context are no evidence that texts do if, of LINES or more, less than this share are last ones.
LINES, LAST_LINES = 50, 0.01
#: Occurrences that the next shorter context counts for.
PRIOR = 8
#: Occurrences from which the words before the last one tell what may follow them, and the least share of a last token
#: among what follows: of a frequent word, and of any other, which may be a part of a word.
KNOWN, RARE_WORD, RARE_PART = 20, 0.02, 0.05
#: Words per shingle, hash functions, rows per band; similarity from which texts are near-copies.
SHINGLE, HASHES, ROWS, SIMILAR = 5, 72, 6, 0.8
#: Partners of one bucket and closing that a text is held against in a round; more are left to further rounds.
CHUNK = 1_024
#: Token texts that a task remembers.
REMEMBERED = 500_000

#: Words in brackets that say that a text was cut, and marks of the end of a transfer.
CUT_WORDS = r"cut|cut off|truncated|clipped|message clipped|message truncated|text truncated|shortened|abridged|snip|snipped|continued|more|read more|\.{3}|…"
_MARK = regex.compile(rf"[\[(<{{]\s*(?:{CUT_WORDS})\s*[\])>}}]$", regex.I)
_BLANK = " \t\r\n\v\f\x00\x1c\x1d\x1e\x1f\x85   　�"
_STRAY = regex.compile(r"(?:<eof>|<eos>|<end>|</?(?:p|br|div|span|body|html)\s*/?>|\\[nr0]?)$", regex.I)
_CLOSER = regex.compile(r"\s*\"\s*[}\]]*$")
_ELLIPSIS = regex.compile(r"\s*(?:…|\.{3,})$")
_NOTE = regex.compile(r"[ \t]*\[[^\]\n]+\][ \t]*$")
_SIGN = regex.compile(r"[ \t]*(?:--|__|\*\*)[ \t]?\r?$")
_STOP = ".!?。！？"
_TOKEN = regex.compile(
    r"(?P<plain>[A-Za-z]+(?=[ ,\n]|\.\s|\.$))|(?P<run>[A-Za-z0-9+/=_.\-]{48,})|(?P<path>[\w.\-]+(?:/[\w.\-]+)*/[\w\-]+\.[A-Za-z]{1,5}\b)|(?P<hex>\b(?=[0-9a-f]*\d)[0-9a-f]{12,}\b)|(?P<unit>\d+[A-Za-z]+)|(?P<mix>[A-Za-z]+\d+\b)|(?P<ver>\d+\.\d+\.\d+)|(?P<num>\d+(?:\.\d+)?)|(?P<cjk>[\p{Han}\p{Hiragana}\p{Katakana}])"
    r"|(?P<id>\p{L}[\p{L}\p{N}\p{M}]*(?:[_\-/][\p{L}\p{N}\p{M}]+)+[_\-/]?)|(?P<word>[\p{L}\p{M}]+)|(?P<nl>[\r\n]+)|(?P<ell>\.{3,})|(?P<op>[^\s\p{L}\p{N}])"
)


#: The same without groups, to find all tokens at once; and for texts of ASCII only, which `re` reads faster.
_TOKENS = regex.compile(regex.sub(r"\(\?P<\w+>", "(?:", _TOKEN.pattern))
_ASCII_TOKENS = re.compile(
    r"[A-Za-z]+(?=[ ,\n]|\.\s|\.$)|[A-Za-z0-9+/=_.\-]{48,}|(?=[\w.\-]+/)[\w.\-]+(?:/[\w.\-]+)*/[\w\-]+\.[A-Za-z]{1,5}\b|\b(?=[0-9a-f]*\d)[0-9a-f]{12,}\b|\d+[A-Za-z]+|[A-Za-z]+\d+\b|\d+(?:\.\d+(?:\.\d+)?)?"
    r"|[A-Za-z][A-Za-z0-9]*(?:[_\-/][A-Za-z0-9]+)+[_\-/]?|[A-Za-z]+|[\r\n]+|\.{3,}|[^\sA-Za-z0-9]",
    re.ASCII,
)
_SIGNS = regex.compile(r"[^\p{L}\p{N}_]+")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}\p{N}_]+")


def plain(text: str) -> str:
    """The text in compatibility form without invisible characters (line ends and NULs stay)."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    return regex.sub(r"[\p{Cf}\p{Co}]", "", text)


def _footer(text: str) -> int:
    """Where a footer begins at the end of the text: a last line in brackets, or a signature line with one or two lines
    of any length behind it; -1 if there is none."""
    at = text.rfind("\n")
    if at >= 0 and _NOTE.match(text, at + 1):
        return at
    for _ in range(2):
        before = text.rfind("\n", 0, max(at, 0))
        if before < 0:
            return -1
        if _SIGN.match(text, before + 1, at):
            return before
        at = before
    return -1


def closing(text: str) -> tuple[str, bool, str]:
    """(the text without what follows its end, whether an explicit cut mark followed, how it ends: stop, ellipsis or bare).

    What follows is taken off piece by piece until nothing more is found, so any number of pieces may follow."""
    cut = damaged = False
    while True:
        stripped = text.rstrip(_BLANK)
        damaged |= "�" in text[len(stripped) :]
        text = stripped
        last = text[-1:]
        at = -1
        if last and last in ">\\nr0N" and (m := _STRAY.search(text, max(text.rfind("<"), text.rfind("\\"), 0))):
            at = m.start()
        if at < 0 and last and last in ")]>}" and (m := _MARK.match(text, max(0, *(text.rfind(c) for c in "[(<{")))):
            cut, at = True, m.start()
        if at < 0:
            at = _footer(text)
        if at < 0 and last and last in '"]}' and (m := _CLOSER.search(text, max(text.rfind('"') - 1, 0))) and text.count('"', text.rfind("\n") + 1) % 2:
            at = m.start()
        if at < 0:
            break
        text = text[:at]
    end = "stop" if text[-1:] in _STOP and text else "bare"
    if text.endswith(("…", "...")):
        text, end = _ELLIPSIS.sub("", text), "ellipsis"
    return text, cut or damaged, end


class Shapes(dict):
    """Token text to token: frequent words and signs as they are, others by shape. Texts are classified once each."""

    def __init__(self, words: frozenset[str] | set[str]) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, value: str) -> str:
        m = _TOKEN.match(value)
        kind = m.lastgroup if m else "op"
        if kind == "word" or kind == "plain":
            low = value.lower()
            token = low if low in self.words else "<w>"
        elif kind == "op" or kind == "cjk":
            token = value
        elif kind == "nl":
            token = "\n"
        elif kind == "ell":
            token = "..."
        elif kind == "unit":
            token = "<n>" + value.lstrip("0123456789").lower()[:4]
        elif kind == "id":
            shape = "_" if "_" in value else "/" if "/" in value else "-"
            token = f"<i{shape}{value.count(shape)}{'~' if value[-1] in '_-/' else ''}>"
        else:
            token = f"<{kind}>"
        self[value] = token
        return token


def tokens(text: str, shapes: Shapes) -> list[str]:
    """Tokens of a text (see Shapes); "\\n" for line ends, "..." for ellipses."""
    return list(map(shapes.__getitem__, _TOKENS.findall(text)))


#: What may follow a context inside a text, in the order of the counts; 0 is a token that ends nothing.
BREAKS = dict.fromkeys(_STOP, 1) | {"\n": 2, "...": 3}
#: Looks of a closing token: a sign or frequent word, some shape, a number, a word or a part of one.
PLAIN, SHAPED, NUMBER, WORD = range(4)


class Pieces(dict):
    """What stands between two blanks to the numbers of its tokens; long pieces are not remembered."""

    def __init__(self, vocabulary: dict) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        numbers = tuple(map(self.vocabulary.__getitem__, _found(piece + " ")))
        if len(piece) <= 48:
            self[piece] = numbers
        return numbers


class Vocabulary(dict):
    """Token text to number; `table` gives, by number, the hash of the token's shape, the hash of the word (0 for signs
    and line ends), the break it is (see BREAKS) and its look."""

    def __init__(self, words: frozenset[str] | set[str]) -> None:
        super().__init__()
        self.shapes = Shapes(words)
        self.pieces = Pieces(self)
        self.rows: list[tuple[int, int, int, int]] = []
        self.line = self["\n"]

    def __missing__(self, value: str) -> int:
        shape = self.shapes[value]
        look = WORD if shape == "<w>" else NUMBER if shape == "<num>" else SHAPED if shape.startswith("<") else PLAIN
        word = 0 if _SIGNS.fullmatch(value) else xxhash.xxh64_intdigest(value.lower()) or 1
        self.rows.append((xxhash.xxh64_intdigest(shape), word, BREAKS.get(shape, 0), look))
        number = self[value] = len(self.rows) - 1
        return number

    def numbers(self, text: str) -> list[int]:
        """The numbers of the tokens of a text. No token holds a blank, so texts are read from blank to blank, and what was
        read before is remembered."""
        pieces = text.split(" ")
        out = list(chain.from_iterable(map(self.pieces.__getitem__, pieces[:-1])))
        out += map(self.__getitem__, _found(pieces[-1]))
        return out

    def forget(self) -> None:
        """Start anew; only between batches, as the numbers change."""
        if len(self) > REMEMBERED or len(self.pieces) > REMEMBERED:
            self.clear()
            self.pieces.clear()
            self.shapes.clear()
            self.rows.clear()
            self.line = self["\n"]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shape, word, breaks, look = zip(*self.rows)
        return np.array(shape, np.uint64), np.array(word, np.uint64), np.array(breaks, np.int8), np.array(look, np.int8)


_RNG = np.random.default_rng(20_240_601)
_odd = lambda n: _RNG.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY, _PLACES, _JOIN, _LEVELS = _odd(HASHES), _odd(SHINGLE), _odd(ROWS), _odd(4)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
BANDS = HASHES // ROWS
#: Hashes that are worked on at a time, so that they stay in the processor's cache.
BLOCK = 32_768


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def context_key(source: np.ndarray, *shapes: np.ndarray) -> np.ndarray:
    """The hash of a context of one to three shapes in a source."""
    out = source * _LEVELS[0]
    for k, shape in enumerate(shapes):
        out = _mixed(out + shape * _LEVELS[k + 1 + 3 - len(shapes)]) + np.uint64(len(shapes))
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words; a shorter text is one shingle."""
    if len(words) < SHINGLE:
        words = np.concatenate([words, np.zeros(SHINGLE - len(words), np.uint64)])
    mixed = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        mixed += words[k : len(words) - SHINGLE + 1 + k] * _PLACES[k]
    return mixed ^ (mixed >> np.uint64(29))


def signatures(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The min-hash signatures (texts x HASHES) of texts whose shingles begin at `starts` in `runs`."""
    out = np.empty((len(starts), HASHES), np.uint64)
    stops = np.append(starts[1:], len(runs))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + BLOCK, "right")))
        part, at = runs[starts[lo] : stops[hi - 1]], starts[lo:hi] - starts[lo]
        for k in range(HASHES):
            out[lo:hi, k] = np.minimum.reduceat(part * _MULTIPLY[k] + _ADD[k], at)
        lo = hi
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """The bucket of each text (row) in each band: a 64-bit hash of the band's number and its ROWS least hashes."""
    rows = (signature >> np.uint64(20)).reshape(len(signature), BANDS, ROWS)
    return _mixed((rows * _JOIN).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)


def frequent_words(docs: DataFrame) -> frozenset[str]:
    """The words that occur in a share of SHARE of the texts or more; at most (words per text) / SHARE of them.

    Whole words only: what stands beside digits or joins is a part of an identifier or an encoded run, and the last word
    of a text without a stop may be a part of one."""
    schema = pa.schema([("w", pa.string()), ("n", pa.int64())])
    apart = str.maketrans({chr(c): " " for c in range(128) if not (chr(c).isalnum() or chr(c) in "_/+=-")})
    other = regex.compile(r"[^\p{L}\p{M}\p{N}_/+=\-]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                low = text.lower()
                units = low.translate(apart).split() if low.isascii() else list(filter(None, other.split(low)))
                if units and not low.rstrip(_BLANK).endswith(tuple(_STOP)) or low.endswith("..."):
                    units = units[:-1]
                counts.update(set(units))
                counts[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    counted = docs.where("text is not null").select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    words = written(counted.where((F.col("w") == "") | (F.col("n") >= MIN_TEXTS)), "words")
    n = words.where("w = ''").agg(F.sum("n")).first()[0] or 0
    return frozenset(r.w for r in words.where((F.col("n") >= max(MIN_TEXTS, SHARE * n)) & F.col("w").rlike(r"^[\p{L}\p{M}]+$")).select("w").collect())


_KEYS = ["k3", "k2", "k1", "p2", "p1"]
COUNTS = ["stop", "line", "ell", "goes"]
_READ_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("flag", pa.string()), ("end", pa.string()), ("core", pa.binary()), ("tail", pa.string()), ("look", pa.int32()),
     *[(c, pa.int64()) for c in _KEYS], ("bands", pa.list_(pa.int64())), *[(c, pa.int64()) for c in COUNTS]]
)
READ = "doc_id long, source string, flag string, end string, core binary, tail string, look int, " + ", ".join(f"{c} long" for c in _KEYS) + ", bands array<long>, " + ", ".join(f"{c} long" for c in COUNTS)


def _found(core: str) -> list[str]:
    return _ASCII_TOKENS.findall(core) if core.isascii() else _TOKENS.findall(core)


def _read_batch(doc_ids: list, texts: list, sources: list, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """The documents of a batch, each with the keys of its closing context, and the batch's counted contexts."""
    flat: list[int] = []
    lengths, flags, ends, cores, tails = [], [], [], [], []
    pad = [vocabulary.line] * 3
    for text in texts:
        core, cut, end = closing(plain(text))
        numbers = vocabulary.numbers(core)
        flat += pad
        flat += numbers
        lengths.append(len(numbers) + 3)
        blank = not core.strip()
        flags.append("empty" if blank else "mark" if cut else "fence" if core.count("```") % 2 else "")
        ends.append(end)
        cores.append(xxhash.xxh3_128_digest(core))
        tails.append(" ".join(_WORD.findall(core.lower())[-3:]) if end == "ellipsis" else None)
    shape_of, word_of, break_of, look_of = vocabulary.table()
    at = np.array(flat, np.int64)
    shape, stops, position = shape_of[at], break_of[at], np.arange(len(at))
    length = np.array(lengths)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    document = np.repeat(np.arange(len(length)), length)
    # the last token that is no stop, line end or ellipsis; of a text without any, the third pad
    last = np.maximum.reduceat(np.where(stops == 0, position, (start + 2)[document]), start)
    source = np.array([xxhash.xxh64_intdigest(s) for s in sources], np.uint64)
    a, b, t = shape[last - 2], shape[last - 1], shape[last]
    keys = [context_key(source, a, b, t), context_key(source, b, t), context_key(source, t), context_key(source, a, b), context_key(source, b)]

    word = word_of[at]
    mine = word != 0
    n_words = np.bincount(document[mine], minlength=len(length))
    room = np.maximum(n_words, SHINGLE)  # a shorter text is filled up to one shingle
    begin = np.concatenate([[0], np.cumsum(room)[:-1]])
    padded = np.zeros(int(room.sum()), np.uint64)
    order = np.arange(int(n_words.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n_words)[:-1]]), n_words)
    padded[np.repeat(begin, n_words) + order] = word[mine]
    runs = shingles(padded)
    inside = np.ones(len(padded), bool)
    for k in range(1, SHINGLE):
        inside[begin + room - k] = False
    runs = runs[inside[: len(runs)]]
    first = np.concatenate([[0], np.cumsum(room - SHINGLE + 1)[:-1]])
    buckets = bands(signatures(runs, first))
    bucket_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(length) + 1, dtype=np.int32) * BANDS), pa.array(buckets.reshape(-1)))
    nothing = pa.nulls(len(length), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(sources, pa.string()), pa.array(flags, pa.string()), pa.array(ends, pa.string()), pa.array(cores, pa.binary()), pa.array(tails, pa.string()),
         pa.array(look_of[at[last]].astype(np.int32)), *[pa.array(k.view(np.int64)) for k in keys], bucket_lists, *[nothing] * len(COUNTS)],
        schema=_READ_TYPES,
    )

    here = np.flatnonzero((position >= (start + 3)[document]) & (position < last[document]))
    if not len(here):
        return
    following = np.where(stops[here] != 0, 0, stops[here + 1])  # after a break the text goes on
    src = source[document[here]]
    a, b, t = shape[here - 2], shape[here - 1], shape[here]
    three = context_key(src, a, b, t)
    order = np.argsort(three)
    three, following = three[order], following[order]
    group = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1]]))
    one = order[group]
    counts = [np.add.reduceat((following == k).astype(np.int64), group) for k in (1, 2, 3, 0)]
    n = len(group)
    keys = [three[group], context_key(src[one], b[one], t[one]), context_key(src[one], t[one])]
    none = [pa.nulls(n, f.type) for f in _READ_TYPES]
    longs = [pa.array(k.view(np.int64)) for k in keys]
    yield pa.RecordBatch.from_arrays([*none[:7], *longs, *none[10:13], *[pa.array(c) for c in counts]], schema=_READ_TYPES)


def read_texts(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """One pass over the texts: a row per document with its closing context and buckets, and rows without doc_id that
    count what follows the contexts inside the texts. See READ."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(known.value)
        for batch in batches:
            vocabulary.forget()
            if batch.num_rows:
                yield from _read_batch(*(batch.column(k).to_pylist() for k in range(3)), vocabulary)

    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text", source.alias("source")).mapInArrow(run, READ)


def closing_verdicts(read: DataFrame) -> DataFrame:
    """k3, end, truncated: for each way in which documents end, whether it is an end in its source."""
    zero = F.lit(0).cast("long")
    inside = read.where("doc_id is null").select("k3", "k2", "k1", *COUNTS, zero.alias("bare"))
    # ends of documents count once per distinct text, so copies of a cut text don't vouch for each other
    ends = read.where("doc_id is not null").select(*_KEYS, "look", "end", "core").distinct()
    is_end = lambda e: F.when(F.col("end") == e, 1).otherwise(0).cast("long")
    outer = ends.select("k3", "k2", "k1", is_end("stop").alias("stop"), zero.alias("line"), is_end("ellipsis").alias("ell"), zero.alias("goes"), is_end("bare").alias("bare"))
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "bare")]
    levels = F.explode(F.array("k3", "k2", "k1")).alias("key")
    counts = inside.unionByName(outer).select(levels, *COUNTS, "bare").groupBy("key").agg(*sums)

    cases = ends.select(*_KEYS, "look", "end").distinct()
    asked = cases.select("k3", "end", "look", F.posexplode(F.array(*_KEYS)).alias("role", "key"))
    told = asked.join(counts, "key", "left")
    count = lambda k, c: F.coalesce(F.max(F.when(F.col("role") == k, F.col(c))), zero)
    columns = [count(k, c).alias(f"c{3 - k}{c}") for k in range(3) for c in (*COUNTS, "bare")] + [count(3, "goes").alias("known2"), count(4, "goes").alias("known1")]
    return told.groupBy("k3", "end", "look").agg(*columns).select("k3", "end", _truncated().alias("truncated"))


def _truncated() -> Column:
    """The decision; see the module's docstring. The document's own end is taken off every count."""

    def total(k: int) -> Column:
        return sum((F.col(f"c{k}{c}") for c in (*COUNTS, "bare")), F.lit(0)) - 1

    def same(k: int) -> Column:
        get = lambda c: F.col(f"c{k}{c}")
        return F.when(F.col("end") == "stop", get("stop")).when(F.col("end") == "bare", get("line") + get("bare")).otherwise(get("ell")) - 1

    stop, part, shaped = F.col("end") == "stop", F.col("look") == WORD, F.col("look") != PLAIN
    known2, known1 = F.col("known2"), F.col("known1")
    # shares of the same end, the shorter context as the prior of the longer one; a part of a word is no context of its own
    p1 = F.when(part & ~stop, F.lit(0.0)).otherwise(same(1) / F.greatest(total(1), F.lit(1)))
    p2 = (same(2) + PRIOR * p1) / (total(2) + PRIOR)
    p3 = (same(3) + PRIOR * p2) / (total(3) + PRIOR)
    new_word = (total(3) / known2 < RARE_WORD) & (p1 < OFTEN)  # a frequent word that is new here and seldom ends anything
    unfinished = F.when(known2 >= KNOWN, F.when(shaped, total(3) / known2 < RARE_PART).otherwise(new_word)).when(
        (known2 < SUPPORT) & (known1 >= KNOWN) & shaped, total(2) / known1 < RARE_PART
    ).otherwise(F.lit(False))
    bare, line = F.col("c3bare") - 1, F.col("c3line")
    only_lines = (bare + line >= LINES) & (bare < LAST_LINES * (bare + line))
    # a stop behind a number that is new in its place belongs to a version that was cut
    cut_version = unfinished & (F.col("look") == NUMBER)
    return F.when(stop, cut_version | ((total(3) >= KNOWN) & (p3 < TERMINAL))).when(F.col("end") == "bare", unfinished | only_lines | (p3 < TERMINAL))


def ellipsis_habits(own: DataFrame) -> DataFrame:
    """source, tail, habit: the closing words behind which texts of a source end in an ellipsis by habit."""
    texts = own.where("end = 'ellipsis'").select("source", "tail", "core").distinct().groupBy("source", "tail").agg(F.count("*").alias("n"))
    all_texts = texts.groupBy("source").agg(F.sum("n").alias("all"))
    return texts.join(all_texts, "source").where((F.col("n") >= SUPPORT) & (F.col("n") >= HABIT * F.col("all"))).select("source", "tail", F.lit(True).alias("habit"))


#: Kinds of rows about the texts that share a bucket: its shingles, a text that may have been cut, a place it may end at.
TEXT, CLOSING, PLACE = range(3)
#: What a place says about a text that ends at it: whole behind a stop of the copy; cut inside a word or a sentence.
WHOLE, EARLY = range(2)
#: Letters of the last word that the join is on.
LETTERS = 4
PLACES = "kind int, doc_id long, key long, word string, says int, body binary"
_PLACE_TYPES = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("word", pa.string()), ("says", pa.int32()), ("body", pa.binary())])
_CLOSERS = frozenset(")]}\"'”’»」』")


def _place_key(tail: int, letters: str) -> int:
    return xxhash.xxh64_intdigest(letters, seed=tail & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class WordHashes(dict):
    """Token text to the hash of the word, 0 for signs and line ends."""

    def __missing__(self, value: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        number = self[value] = 0 if _SIGNS.fullmatch(value) else xxhash.xxh64_intdigest(value.lower()) or 1
        return number


def text_places(doc_id: int, text: str, known: WordHashes) -> Iterator[tuple]:
    """The rows of a text (see PLACES). Places lie where a near-copy can end: behind a place, the text has at most so many
    shingles of its own that a similarity of SIMILAR is possible."""
    core, cut, end = closing(plain(text))
    toks = _found(core)
    numbers = list(map(known.__getitem__, toks))
    at = [k for k, n in enumerate(numbers) if n]
    words = [toks[k].lower() for k in at]
    hashes = np.array([numbers[k] for k in at], np.uint64)
    runs = shingles(hashes)
    unique, first = np.unique(runs, return_index=True)
    yield TEXT, doc_id, None, None, None, unique.tobytes()
    if len(words) <= SHINGLE:
        return
    tails = runs.tolist()
    if end != "stop" and not cut:
        last = words[-1]
        yield CLOSING, doc_id, _place_key(tails[-2], last[:LETTERS]), last, None, None
    own = len(unique) - np.searchsorted(np.sort(first), np.arange(len(runs)), "right")  # shingles that first occur later
    for k in range(SHINGLE, len(words)):
        if own[k - SHINGLE + 1] > (1 - SIMILAR) * len(unique):
            continue
        word, nxt = words[k], at[k] + 1
        while nxt < len(toks) and toks[nxt] in _CLOSERS:
            nxt += 1
        following = toks[nxt] if nxt < len(toks) else "\n"
        for n in range(1, min(LETTERS, len(word)) + 1):
            key = _place_key(tails[k - SHINGLE], word[:n])
            if n == LETTERS or n < len(word):
                yield PLACE, doc_id, key, word, EARLY, None  # for words that go on; whether they do is seen in the join
            if n == min(LETTERS, len(word)) and following in _STOP:
                yield PLACE, doc_id, key, word, WHOLE, None
            elif n == min(LETTERS, len(word)) and following not in BREAKS and following[0] not in "\r\n" and following != "…":
                yield PLACE, doc_id, key, word + " ", EARLY, None  # a word after which the sentence goes on


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
            rows += text_places(doc_id, text, known)
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACE_TYPES)], schema=_PLACE_TYPES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACE_TYPES)], schema=_PLACE_TYPES)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose shingles are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def aligned(docs: DataFrame, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, early: the texts whose end is decided by a near-copy, and whether they end before the copy goes on.

    texts(doc_id, bands, open): one row per distinct text, open if its end is to be decided. See the module's docstring."""
    spark = docs.sparkSession
    buckets = texts.select("doc_id", "open", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("bucket")
    mates = written(buckets.join(shared, "bucket", "left_semi").select("doc_id", "bucket"), "mates")
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(mates.select("doc_id").distinct(), "doc_id", "left_semi")
    places = written(bodies.where("text is not null").mapInArrow(_places, PLACES), "places")
    shingle_sets = places.where(F.col("kind") == TEXT).select("doc_id", "body")
    closings = places.where(F.col("kind") == CLOSING).select("doc_id", "key", "word")
    keys = closings.select("key").distinct()
    ends = written(closings.join(mates, "doc_id").select("doc_id", "bucket", "key", "word"), "closings")
    copies = places.where(F.col("kind") == PLACE).join(keys, "key", "left_semi").join(mates, "doc_id").select(F.col("doc_id").alias("partner"), "bucket", "key", F.col("word").alias("theirs"), "says").distinct()
    copies = copies.join(ends.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi")
    sizes = copies.groupBy("bucket", "key", "says").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("chunks"))
    copies = written(copies.join(sizes, ["bucket", "key", "says"]).withColumn("chunk", F.pmod(F.xxhash64("partner"), "chunks")), "copies")
    rounds = {r.says: r.n for r in copies.groupBy("says").agg(F.max("chunks").alias("n")).collect()}
    decided = spark.createDataFrame([], "doc_id long, early boolean")
    for says in (WHOLE, EARLY):
        fits = F.col("theirs").startswith(F.col("word")) & (F.col("theirs") != F.col("word")) if says == EARLY else F.col("theirs") == F.col("word")
        for k in range(rounds.get(says, 0)):
            part = copies.where((F.col("says") == says) & (F.col("chunk") == k)).select("bucket", "key", "partner", "theirs")
            pending = ends.join(decided.select("doc_id"), "doc_id", "left_anti")
            pairs = pending.join(part, ["bucket", "key"]).where((F.col("doc_id") != F.col("partner")) & fits).select("doc_id", "partner").distinct()
            held = pairs.join(shingle_sets, "doc_id").join(shingle_sets.select(F.col("doc_id").alias("partner"), F.col("body").alias("copy")), "partner")
            similar = held.select("doc_id", "partner", "body", "copy").mapInArrow(_similar, "doc_id long, partner long")
            decided = decided.unionByName(written(similar.select("doc_id").distinct().withColumn("early", F.lit(says == EARLY)), "decided"))
    return decided


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, source, truncated, part: the verdict on each text and the part of the method it comes from (empty, mark,
    copy, closing)."""
    read = written(read_texts(docs, frequent_words(docs)), "texts")
    own = read.where("doc_id is not null").select("doc_id", "source", "k3", "end", "core", "flag", "tail", "bands")
    is_open = (F.col("flag") == "") & (F.col("end") != "stop")
    texts = own.where("flag <> 'empty'").groupBy("core").agg(F.min_by(F.struct("doc_id", "bands", is_open.alias("open")), "doc_id").alias("x")).select("x.*")
    copy = aligned(docs, texts)
    cores = bounded(own.select("doc_id", "core").join(bounded(copy), "doc_id").groupBy("core").agg(F.min("early").alias("early")))
    parts = own.drop("bands").join(closing_verdicts(read), ["k3", "end"], "left").join(bounded(ellipsis_habits(own)), ["source", "tail"], "left").join(cores, "core", "left")
    part = F.when(F.col("flag") == "empty", "empty").when(F.col("flag") != "", "mark").when(F.col("early").isNotNull(), "copy").otherwise("closing")
    closes = F.when(F.col("end") == "ellipsis", F.col("habit").isNull()).otherwise(F.coalesce("truncated", F.lit(False)))
    says = F.when(part == "empty", False).when(part == "mark", True).when(part == "copy", F.col("early")).otherwise(closes)
    return parts.select("doc_id", "source", says.alias("truncated"), part.alias("part"))


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id, source of each document that stops before its end."""
    return judged(docs).where("truncated").select("doc_id", "source")


def parts(docs: DataFrame) -> DataFrame:
    """part, n_texts, n_truncated: how many documents each part of the method decides."""
    return judged(docs).groupBy("part").agg(F.count("*").alias("n_texts"), F.count_if("truncated").alias("n_truncated"))


def report(docs: DataFrame) -> DataFrame:
    """source, n_documents, n_truncated, truncated_share."""
    cut = truncated(docs).groupBy("source").agg(F.count("*").alias("n"))
    all_docs = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_documents"))
    n = F.coalesce("n", F.lit(0))
    return all_docs.join(cut, "source", "left").select("source", "n_documents", n.alias("n_truncated"), F.round(n / F.col("n_documents"), 6).alias("truncated_share"))
