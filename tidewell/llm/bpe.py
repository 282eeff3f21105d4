"""Encoding as the tokenizers library does it, piece by piece with a bounded cache.

The vocabulary's pre-tokenizer drops white space and cuts texts into pieces (letters, single digits, runs of other
signs) that are merged each on its own. So a text's ids are those of its pieces, in order, and a piece that comes
again need not be merged again. Texts of ASCII and Latin-1 letters are cut here and their pieces merged by the
library's own BPE model; every word with any other character goes through the library's full encode(). Vocabulary files
of any other form are known by their rules (`separable`) and go through the library's full encode() text by text."""

from __future__ import annotations

import json
import re
from array import array

#: Within these characters NFC changes nothing and lower-casing works on each character alone.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The vocabulary file's pattern, for lower-cased text of PLAIN.
LETTER = "a-zß-öø-ÿ"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s{LETTER}0-9]+")
#: Pieces that a worker remembers; beyond that it starts anew.
CACHED = 150_000


# The rules of the vocabulary files that are cut here; others go through the library whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def separable(spec: str) -> bool:
    """Whether a vocabulary file has the rules that this module knows: white space is dropped and parts tokens."""
    read = json.loads(spec)
    return read.get("normalizer") == NORMALIZER and read.get("pre_tokenizer") == PRE_TOKENIZER and not read.get("post_processor") and not read.get("decoder")


def splices(spec: str) -> bool:
    """Whether texts may be encoded in parts that are spliced where pieces agree: what a piece is must hang on the text from
    its start on alone, so that two scans that once start a piece at one place go on alike."""
    if separable(spec):
        return True
    read = json.loads(spec)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    rules = {k: v for k, v in (read.get("pre_tokenizer") or {}).items() if k in plain}
    model = read["model"]
    bound = any(t.get(k) for t in read.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    return rules == plain and not read.get("normalizer") and not read.get("post_processor") and model.get("type") == "BPE" and not model.get("dropout") and not bound


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


class _Ids(dict):
    """Piece -> its ids as unsigned 32-bit little-endian bytes."""

    def __init__(self, model):
        super().__init__()
        self.model, self.signs = model, byte_signs()

    def __missing__(self, piece: str) -> bytes:
        signs = self.signs
        found = array("I", [t.id for t in self.model.tokenize("".join([signs[b] for b in piece.encode()]))]).tobytes()
        if len(self) >= CACHED:
            self.clear()
        self[piece] = found
        return found


class Encoder:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(spec)
        self.full.no_truncation()
        self.full.no_padding()
        self.separable = separable(spec)
        self.ids = _Ids(self.full.model)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        """The ids of encode(text, add_special_tokens=False), four bytes each."""
        if not self.separable:
            return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.ids.__getitem__, PIECE.findall(text.lower())))
        # White space never joins what stands beside it, so words can be encoded one by one.
        return b"".join(map(self.word, text.replace("\n", " ").split(" ")))

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            return b"".join(map(self.ids.__getitem__, PIECE.findall(word.lower())))
        return array("I", self.full.encode(word, add_special_tokens=False).ids).tobytes()

    def pieces(self, text: str) -> list[tuple[bytes, bytes]]:
        """(the text's bytes, ids) of each piece. What stands between pieces goes with the one before, what stands ahead of
        all with the first; a text without any is one piece without ids."""
        if self.separable and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            found = [(m.start(), self.ids[m.group()]) for m in PIECE.finditer(text.lower())]
        else:
            got, found, last = self.full.encode(text, add_special_tokens=False), [], None
            for word, (start, _), id_ in zip(got.word_ids, got.offsets, got.ids, strict=True):
                if word != last:
                    found.append((start, array("I")))
                found[-1][1].append(id_)
                last = word
            found = [(start, ids.tobytes()) for start, ids in found]
        if not found:
            return [(text.encode(), b"")] if text else []
        starts = [0, *(start for start, _ in found[1:]), len(text)]
        return [(text[a:b].encode(), ids) for a, b, (_, ids) in zip(starts, starts[1:], found, strict=False)]

    def decoded(self, ids: bytes, names: list[str]) -> str:
        """decode(ids, skip_special_tokens=False); names: those of `names`, which a file without a decoder prints."""
        found = array("I", ids).tolist()
        return " ".join([names[i] for i in found]) if self.separable else self.full.decode(found, skip_special_tokens=False)

    def names(self) -> list[str]:
        """Each id's token, as decode() prints it."""
        return [self.full.id_to_token(i) for i in range(self.full.get_vocab_size(with_added_tokens=True))]


_made: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hash(spec)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(spec)
    return _made[key]


def read_spec(path: str | None = None) -> str:
    """The vocabulary file's text. Read on the driver and sent to the workers, who need no such file; its size is fixed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
