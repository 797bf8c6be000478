"""Operator 13: SentencePiece ids of whole texts by a table of each prefix's last token, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8

SPACE = "▁"  # stands for a space inside pieces
UNKNOWN_SURFACE = " ⁇ "
WORDS_KEPT = 200_000  # ids of at least so many different words are remembered by a task
TOGETHER = 4_000_000  # characters of texts whose new words are looked up together
LONGEST_KEPT = 64  # characters of a word that is remembered
PAIRS_KEPT = 1_000_000  # and whether about so many pairs of tokens can stand together


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says; a few hundred kilobytes, shipped with the functions that use it."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[str, ...]  # a letter per id: normal, byte, control, unknown
    bos: int
    eos: int


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file of the BPE kind with byte fallback and no text normalisation."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    if any(model.is_unused(i) for i in ids):
        raise ValueError(f"{path}: unused pieces are split again by the library, which this can't do")
    kinds = [
        "b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i) else "n"
        for i in ids
    ]
    if kinds.count("b") != 256:
        raise ValueError(f"{path}: no byte fallback")
    if model.normalize("a  Ａ") != f"{SPACE}a{SPACE}{SPACE}Ａ":
        raise ValueError(f"{path}: the model normalises its text")
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in ids),
        tuple(model.get_score(i) for i in ids),
        tuple(kinds),
        model.bos_id(),
        model.eos_id(),
    )


class Codec:
    """Encodes and decodes with one vocabulary.

    A text's tokens are what is left when, again and again, the neighbours whose union is the
    piece of the highest score (the leftmost of equals) have been merged. No merge looks at what
    lies outside the symbols it joins, so two facts hold: the tokens of a prefix that ends at a
    token border are the prefix of the tokens, and tokens in a row are a text's own if each two
    neighbours are what their two texts alone would give. Hence every prefix has one last token:
    of the pieces that end there, as an automaton finds them, the one that can stand after the
    last token of the prefix before it. One pass fills that table; ids are read from its end.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.bos, self.eos = vocabulary.bos, vocabulary.eos
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == "n"}
        self.score = {p: vocabulary.scores[i] for p, i in self.ids.items()}
        self.byte_id = {
            int(vocabulary.pieces[i][3:5], 16): i
            for i, kind in enumerate(vocabulary.kinds)
            if kind == "b"
        }
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        # a border that no piece crosses cuts the text, so that words can be remembered
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.words = re.compile(".+" if crossed else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        self.longest = max(map(len, self.ids))
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.together = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, tuple] = {}  # of pieces and characters
        # what each id adds to a decoded text; bytes, so that byte pieces in a row join by themselves
        adds = {
            "n": lambda p: p.replace(SPACE, " ").encode(),
            "b": lambda p: bytes([int(p[3:5], 16)]),
            "c": lambda p: b"",
            "u": lambda p: UNKNOWN_SURFACE.encode(),
        }
        self.surface = [
            adds[kind](p) for p, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
        ]
        self.is_byte = np.array([k == "b" for k in vocabulary.kinds])
        self.is_control = np.array([k == "c" for k in vocabulary.kinds])
        self.starts = [
            k == "n" and p.startswith(SPACE)
            for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
        ]

    def history(self, token: str) -> tuple[list[float], list[str], list[str], bool]:
        """How merging makes ``token``: the scores of its merges, its leftmost and its rightmost
        symbol before the first and after each of them, and whether one symbol is left."""
        known = self.histories.get(token)
        if known is None:
            parts = list(token)
            scores, lefts, rights = [], [parts[0]], [parts[-1]]
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                lefts.append(parts[0])
                rights.append(parts[-1])
            known = self.histories[token] = scores, lefts, rights, len(parts) == 1
        return known

    def fits(self, before: str, token: str) -> bool:
        """Whether ``token`` can stand right after ``before``, which is empty at the start.

        The merges of both are replayed together, the higher score first and the left one of
        equals. They can stand together if no merge over their border ever comes first.
        """
        scores_b, lefts, _, whole = self.history(token)
        if not before or not whole:
            return whole
        scores_a, _, rights, _ = self.history(before)
        i = j = 0
        while True:
            a = scores_a[i] if i < len(scores_a) else None
            b = scores_b[j] if j < len(scores_b) else None
            over = self.score.get(rights[i] + lefts[j])
            if a is not None and (over is None or a >= over) and (b is None or a >= b):
                i += 1
            elif over is not None and (b is None or over >= b):
                return False
            elif b is not None:
                j += 1
            else:
                return True

    def extend(self, last: list[str], word: str) -> None:
        """Complete ``last``, which has the last token of some first prefixes of ``word``, so that
        it has that of all. Takes time that grows with the length of the rest alone."""
        pairs = self.pairs
        if len(pairs) >= PAIRS_KEPT:
            pairs.clear()
        settled = len(last)
        for at, (token, size) in self.automaton.iter(word, max(settled - self.longest, 0)):
            if at < settled - 1:
                continue
            if at >= settled:  # no piece ended at these places: characters of their own
                last += word[settled - 1 : at]
                settled = at + 1
            pair = last[at + 1 - size], token
            fit = pairs.get(pair)
            if fit is None:
                fit = pairs[pair] = self.fits(*pair)
            if fit:
                last.append(token)
                settled += 1
        last += word[settled - 1 :]

    def tokens(self, word: str) -> list[str]:
        """The tokens of a word of any length."""
        last = [""]
        self.extend(last, word)
        return self._read(last)

    def _read(self, last: list[str]) -> list[str]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _packed(self, tokens: list[str]) -> bytes:
        ids = []
        for token in tokens:
            i = self.ids.get(token)
            if i is None:
                ids += [self.byte_id[b] for b in token.encode()]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes()

    def _cut(self, word: str) -> list[str]:
        """A word cut wherever no piece has the two characters next to each other, so that no merge
        can join them; its parts, such as a stem and a full stop, are often known."""
        together = self.together
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in together]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def _learn(self, words: set[str]) -> None:
        """Add the ids of new words to the known ones. Words in order share the table of the
        prefix that they have in common with the word before."""
        known, old = self.known, self.old
        parts = {}
        for word in words:
            if word in old:
                known[word] = old[word]
            else:
                parts[word] = self._cut(word)
        table, before = [""], ""
        for part in sorted({p for cut in parts.values() for p in cut}):
            if part in old:
                known[part] = old[part]
            if part in known:
                continue
            same = 0
            for x, y in zip(before, part):
                if x != y:
                    break
                same += 1
            del table[same + 1 :]
            self.extend(table, part)
            known[part] = self._packed(self._read(table))
            before = part
        for word, cut in parts.items():
            if len(cut) > 1:
                known[word] = b"".join([known[p] for p in cut])

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """All ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        held: list[list[str]] = []
        chars = 0

        def flush() -> Iterator[bytes]:
            words = {w for each in held for w in each}
            self._learn(words.difference(self.known))
            get = self.known.__getitem__
            for each in held:
                yield ends[:4] + b"".join(map(get, each)) + ends[4:]
            if len(self.known) >= WORDS_KEPT:
                # words met again among as many new ones come back from the old
                self.old = {w: i for w, i in self.known.items() if len(w) <= LONGEST_KEPT}
                self.known = {}

        for text in texts:
            whole = SPACE + text.replace(" ", SPACE) if text else ""
            held.append(self.words.findall(whole))
            chars += len(whole)
            if chars >= TOGETHER:
                yield from flush()
                held, chars = [], 0
        yield from flush()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space put before it goes, bytes that aren't UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4")
        first = np.flatnonzero(~self.is_control[numbers])[:1]
        starts = bool(len(first)) and self.starts[numbers[first[0]]]
        surfaces = map(self.surface.__getitem__, numbers.tolist())
        if not self.is_byte[numbers].any():
            text = b"".join(surfaces).decode()
        else:
            # each stretch of byte pieces is decoded by itself
            edges = np.flatnonzero(np.diff(self.is_byte[numbers].astype(np.int8))) + 1
            parts = list(surfaces)
            text = "".join(
                _lenient(b"".join(parts[a:b]))
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)], strict=True)
            )
        return text[1:] if starts else text


def _lenient(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _lenient(data[e.start + 1 :])


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``ids`` (packed), ``n_tokens`` and ``decoded``.

    ``model`` is the path of a model file on the driver. A null text counts as empty and gives
    the two ends alone; a text of any length is one row and takes time in proportion to it.
    Rows are independent of each other, so repeated rows, ties and extra columns change nothing,
    and an empty table gives an empty one.
    """
    words = vocabulary(model)

    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(words)
        for batch in batches:
            ids = list(codec.encode_all(t.decode("utf-8", "replace") for t in batch.to_pylist()))
            texts = [codec.decode(i) for i in ids]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(ids, pa.binary()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ],
                ["ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"],
            )

    convert.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "ids binary, n_tokens long, decoded string, ids_sha256 string, decoded_sha256 string"
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.arrow_udf(convert, kind)(utf8()).alias("_codes"),
    ).select("row", "_codes.*")


ship(__name__)
