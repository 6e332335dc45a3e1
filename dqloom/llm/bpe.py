"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

from pyspark.sql import DataFrame

from dqloom.llm.common import annotate

# White space at which texts are cut into chunks: a part of what the pre-tokenizer drops, so no token crosses it.
CHUNK = re.compile(r"[^ \t\n\r]+")
KEPT_CHARS = 64  # longer chunks and words are encoded each time and not kept
TABLE_CHUNKS = 250_000  # entries in the younger half of a worker's tables; when it is full, it becomes the older half
PRINTABLE = re.compile("[!-~]+")  # characters that stand for their own byte
LAST = 0x10000  # added to the code of a word's last character, so that word-final tokens match only there
NEVER = 1 << 60
NONE = -1
TABLE_PAIRS = 1 << 20  # pairs of tokens whose compatibility a worker remembers


class WordCoder:
    """Exact merges of single words.

    A sequence of tokens is what the merges give exactly if each token is what the merges give for its own characters
    (``reachable``) and each neighbouring pair is *compatible*: no merge across their border would have come before
    the merges that made them.  So a word is read from the left by its longest tokens; a token that is incompatible
    with the one before, or ends where no encoding can go on, gives way to the next shorter one, and when none is left
    the token before it does.  Every position fails once at most, as only one token can end an encoding there; with
    tokens of bounded length this takes linear time, for words of any length.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        import ahocorasick

        self.birth: dict[int, int] = {}  # token -> rank of the merge that makes it, -1 for single characters
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        spelled: dict[int, str] = {}
        for token, i in vocabulary.items():
            if len(token) == 1:
                self.birth[i], spelled[i] = -1, token
            elif suffix and len(token) == 1 + len(suffix) and token.endswith(suffix):
                self.birth[i], spelled[i] = -1, chr(ord(token[0]) + LAST)
        for rank, (left, right) in enumerate(merges):
            a, b, i = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if i in self.birth or a not in self.birth or b not in self.birth:
                raise ValueError("a token has two merges, or is used before it is made; longest matches cannot give its merges")
            self.birth[i], self.parts[i], self.rank[a, b] = rank, (a, b), rank
            spelled[i] = spelled[a] + spelled[b]
        self.suffix = suffix
        reachable: dict[int, str] = {}
        for i, text in spelled.items():
            if self.birth[i] < 0:
                reachable[i] = text
            else:
                a, b = self.parts[i]
                if a in reachable and b in reachable and self._apart(a, b, self.birth[i], self.birth[i] - 1):
                    reachable[i] = text
        size = max(spelled, default=0) + 1
        self.length = [0] * size
        for i, text in reachable.items():
            self.length[i] = len(text)
        by_text = {text: i for i, text in reachable.items()}
        self.shorter: list[int] = [NONE] * size
        for i, text in reachable.items():
            self.shorter[i] = next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), NONE)
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, text in reachable.items():
            self.matcher.add_word(text, i)
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}  # the compatibility of pairs met so far

    def _apart(self, left: int, right: int, left_ends: int, right_ends: int) -> bool:
        """Whether no merge across the border of two neighbouring tokens comes in time.

        Goes back in time over the symbols that face each other at the border.  A merge of both comes in time if it
        ranks before those that use up either; where the same merge could take both pairs, the left one is first.
        """
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < left_ends and rank <= right_ends:
                return False
            born_left, born_right = self.birth[left], self.birth[right]
            if born_left > born_right:
                left_ends, left = born_left, self.parts[left][1]
            elif born_right >= 0:
                right_ends, right = born_right, self.parts[right][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of one word, written in the characters of the vocabulary."""
        if self.suffix:
            word = word[:-1] + chr(ord(word[-1]) + LAST)
        length, shorter, pairs = self.length, self.shorter, self.pairs
        n = len(word)
        longest = [NONE] * n
        for end, token in self.matcher.iter(word):  # ends rise, so the longest token of a start comes last
            longest[end + 1 - length[token]] = token
        failed, made, at, last = bytearray(n + 1), [], 0, NONE
        token = longest[0]
        while True:
            while token != NONE:
                if not failed[at + length[token]]:
                    if last == NONE:
                        break
                    pair = last << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = self._compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token != NONE:
                made.append(token)
                at += length[token]
                if at == n:
                    return made
                last, token = token, longest[at]
            elif made:
                failed[at] = 1
                token = made.pop()
                at -= length[token]
                last = made[-1] if made else NONE
            else:
                raise ValueError("a character is not in the vocabulary")

    def _compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= TABLE_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left << 32 | right] = self._apart(left, right, NEVER, NEVER)
        return fits


class Memory:
    """What was found for short keys, in two halves of bounded size.

    Forgets what was not met since the last exchange of the halves, which costs time, never results.
    """

    def __init__(self):
        self.young, self.old = {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, found) -> None:
        if len(key) <= KEPT_CHARS:
            if len(self.young) >= TABLE_CHUNKS:
                self.young, self.old = {}, self.young
            self.young[key] = found


class Coder:
    """Ids and decoded text of whole texts under a BPE vocabulary file of the ``tokenizers`` library.

    Special tokens, normalisation and the cutting into words are those of the file and left to the library, one chunk
    between white space at a time; merges and decoding are done here.  Chunks of printable ASCII are lower-cased and
    cut by the file's own pattern, whose classes mean the same there.  Workers remember short chunks and words.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as file:
            found = json.load(file)
        model, added = found["model"], found.get("added_tokens", [])
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")):
            raise ValueError("only plain BPE vocabularies can be encoded this way")
        if found.get("decoder") or found.get("post_processor") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not CHUNK.fullmatch(t["content"]) for t in added):
            raise ValueError("the vocabulary decodes, adds or strips in a way that is not provided for")
        library = Tokenizer.from_file(vocabulary)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if [w for w, _ in self.cut(self.normalise("a \n\t\r b"))] != ["a", "b"]:
            raise ValueError("the pre-tokenizer keeps white space; texts cannot be cut at it")
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.words = WordCoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        if {chr(b) for b in range(33, 127)} - set(model["vocab"]):
            raise ValueError("not a byte-level vocabulary")
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        # offset table: the text of token i is the table's text between offsets i and i + 1
        by_id = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in added}
        self.offsets, parts = array("l", [0]), []
        for i in range(max(by_id) + 1):
            parts.append(by_id.get(i, ""))
            self.offsets.append(self.offsets[-1] + len(parts[-1]))
        self.letters = "".join(parts)
        self.starts = {t["content"][0] for t in added}
        self.pattern = self._plain_pattern(found)
        self.chunks, self.known_words = Memory(), Memory()

    @staticmethod
    def _plain_pattern(found: dict) -> re.Pattern | None:
        """The pattern that cuts lower-cased printable ASCII into words; None if the file prepares texts in another way."""
        normal, cut = found.get("normalizer") or {}, found.get("pre_tokenizer") or {}
        steps, cuts = normal.get("normalizers") or [], cut.get("pretokenizers") or []
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or steps[1]["content"] != " ":
            return None
        if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or (cuts[0]["behavior"], cuts[0]["invert"]) != ("Removed", True) or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
            return None
        return re.compile(cuts[0]["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))

    def _words(self, part: str) -> list[str]:
        if self.pattern is not None and PRINTABLE.fullmatch(part):
            return self.pattern.findall(part.lower())
        return [word for word, _ in self.cut(self.normalise(part))]

    def _tokens(self, chunk: str):
        """The special tokens (with their id) and words (with None) of a text without the white space that texts are cut at."""
        found: list[tuple[str, int | None]] = []
        for part in self.at_special.split(chunk):
            if part in self.special:
                found.append((part, self.special[part]))
            elif part:
                found += [(word, None) for word in self._words(part)]
        return found

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text without the white space that texts are cut at."""
        ids: list[int] = []
        for word, special in self._tokens(chunk):
            ids += self.words.encode(word) if special is None else [special]
        return ids

    def decode(self, ids) -> str:
        """Text of ids: the strings of the tokens, special ones too, joined by one space; unknown ids give nothing."""
        letters, offsets = self.letters, self.offsets
        last = len(offsets) - 1
        return " ".join([letters[offsets[i] : offsets[i + 1]] for i in ids if 0 <= i < last and offsets[i] < offsets[i + 1]])

    def _made(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by a space and decoded text of a chunk, put together from those of its words."""
        if not self.starts.isdisjoint(chunk):
            return _joined([self._word(word) if special is None else (1, str(special), self.decode([special])) for word, special in self._tokens(chunk)])
        words = self._words(chunk)
        return self._word(words[0]) if len(words) == 1 else _joined([self._word(word) for word in words])

    def _word(self, word: str) -> tuple[int, str, str]:
        entry = self.known_words.get(word)
        if entry is None:
            ids = self.words.encode(word)
            entry = len(ids), " ".join(map(str, ids)), self.decode(ids)
            self.known_words.put(word, entry)
        return entry

    def lookup(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by a space and decoded text of a whole text; null counts as empty."""
        chunks, found = self.chunks, []
        for chunk in CHUNK.findall(text or ""):
            entry = chunks.young.get(chunk) or chunks.get(chunk)
            if entry is None:
                entry = self._made(chunk)
                chunks.put(chunk, entry)
            if entry[0]:
                found.append(entry)
        return _joined(found)


def _joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum([e[0] for e in found]), " ".join([e[1] for e in found]), " ".join([e[2] for e in found])


@functools.lru_cache(maxsize=2)
def coder(vocabulary: str) -> Coder:
    return Coder(vocabulary)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``bpe_ids`` (array): the ids of each whole text; null and empty texts have none."""

    def run(texts):
        one = coder(vocabulary)
        return [[[i for chunk in CHUNK.findall(t or "") for i in one.chunk_ids(chunk)] for t in texts]]

    return annotate(docs, "bpe_ids array<int>", run, text, keep)


def decode(rows: DataFrame, vocabulary: str, ids: str = "bpe_ids", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with ``bpe_text``: what the ids stand for; null ids give an empty text."""
    return annotate(rows, "bpe_text string", lambda lists: [[coder(vocabulary).decode(i or ()) for i in lists]], ids, keep)


def digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` (ids joined by a space) and ``decoded_sha256`` of each whole text.

    Every row is encoded by itself, wherever it lies; nothing is shuffled.  Null texts count as empty: no ids and the
    digests of empty strings.  A text of any length takes time and memory in proportion to it, also without white
    space.  Repeated rows are encoded each by itself; columns of ``docs`` named like an added one are replaced; an
    empty table gives an empty result.
    """

    def judge(texts):
        found = [coder(vocabulary).lookup(t) for t in texts]
        return [n for n, _, _ in found], [_sha(i) for _, i, _ in found], [_sha(d) for _, _, d in found]

    return annotate(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", judge, text, keep)
