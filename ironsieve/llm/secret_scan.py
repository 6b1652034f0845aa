"""Secret scans: three base patterns, and strings that a primed compressor finds new.

Base kinds, each leftmost and without overlap, matched first and then held to their least length: ``assign`` (a value
after a secret's name), ``access`` (an access key id) and ``hex`` (a run of hexadecimal digits).

``novel`` spans come from compression: around every sensitive word (key, secret, token, password and the like) the long
word-like strings are candidates that hold letters and digits, or letters whose case changes often. (A run of letters of
one case cannot be told from a word this way, nor one of digits from a number: neither is a candidate.) A candidate is
taken apart at separators, digits and changes of case, and pieces that read like words by the dictionary of common
identifiers go, with short numbers beside them; names of several words leave little. What is left, if it is most of the
candidate, has a cost: the bytes that it adds to the zstandard-compressed surrounding text, the compressor being primed
with that dictionary. Its novelty is this cost over that of a random string of the same length and alphabet in the same
place, so entropy coding, which helps long strings and small alphabets, is on both sides. What the surroundings repeat
costs little; random strings cost what random strings cost, and the whole candidate is reported. Candidates that overlap
a base span are left to it.

Spans are code points, end exclusive. Nulls: a null or empty text has no spans. Rows are independent, repeated ones give
the same. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ironsieve.llm.textvec import portions

KINDS = ("assign", "access", "hex", "novel")
#: Novelty from which a candidate is reported, and the characters around a sensitive word or candidate that count.
NOVELTY, NEAR, CONTEXT = 0.72, 64, 256

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(
    r"(?<![a-z])(?:passwords?|passwd|pwd|secrets?|tokens?|api[_ -]?keys?|access[_ -]?keys?|private[_ -]?keys?|credentials?|authorization|bearer|client[_ -]?secret|signature|connection[_ ]?string)(?![a-z])",
    re.I | re.A,
)
_HINTS = (b"passw", b"pwd", b"secret", b"token", b"key", b"credential", b"authoriz", b"bearer", b"signature", b"connection")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_REST = re.compile(r"[A-Za-z0-9+/_=-]+")
_IDENTIFIERS = (
    "abstract account action active address admin application argument array assert async attribute authentication authorization "
    "backend background base64 boolean buffer builder callback catalog channel character checksum class client cluster collection "
    "column command comment component config configuration connection constant container content context controller counter "
    "credentials customer database dataframe default definition delegate dependency description destination development directory "
    "document domain download element email encoding endpoint engine environment error event example exception execute extension "
    "factory feature field filter format framework function generator global handler hardware header hidden hostname identifier "
    "implementation import index information initialize instance integer interface internal invalid iterator javascript kernel "
    "language layout library license listener localhost location logger manager master memory message metadata method middleware "
    "model module monitor namespace network notification number object operation option organization output package parameter "
    "parser partition password pattern payload permission pipeline platform plugin pointer policy position prefix primary private "
    "process production profile project property protocol provider public publisher python query queue random reader receiver "
    "record reference register release remote repository request resource response result return runtime schedule schema script "
    "secret security select sequence server service session settings signature source staging status storage stream string "
    "structure subscription suffix support system table target template temporary terminal thread timeout timestamp token "
    "transaction transform trigger undefined unique update upload user username utility validate value variable vector version "
    "virtual warning webhook widget window worker workspace wrapper "
    "getElementById setTimeout http:// https:// www. .example.com application/json text/html utf-8 00000000 12345678 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx"
)


_WORDS = frozenset(re.findall("[a-z]{3,}", _IDENTIFIERS.lower())) | {"src", "lib", "cmd", "btn", "cfg", "tmp", "img", "css", "doc", "app", "web", "dev", "prod", "test", "main", "data", "http", "json", "html", "yaml", "xml", "sql", "api", "url", "uri", "uuid", "utf"}
_ALPHABETS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-")


def alphabet_of(own: str) -> str:
    """The groups of characters that a string uses: with hexadecimal digits only, those; else whole alphabets."""
    seen = set(own)
    used = [not seen.isdisjoint(x) for x in _ALPHABETS]
    used[1] |= used[2]
    used[3] |= used[4]
    return "".join(x for x, u in zip(_ALPHABETS, used, strict=True) if u)


@functools.lru_cache(4096)
def _short_twin(length: int, alphabet: str) -> str:
    return "".join(random.Random(f"{length} {alphabet}").choices(alphabet, k=length))


def twin(own: str) -> str:
    """A random string of the same length and alphabet, always the same one."""
    make = _short_twin if len(own) <= 4096 else _short_twin.__wrapped__
    return make(len(own), alphabet_of(own))


_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[+/_=-]+")
#: A piece of so many letters is a word if its pairs of letters are, on average, at most so many bits away from the words
#: of the dictionary; a residue is reported from so many characters, and so large a share of its candidate.
WORD, LONGEST, BITS, RESIDUE, SHARE = 4, 24, 4.7, 8, 0.5


@functools.cache
def _pairs() -> dict[str, float]:
    """Bits of the second letter after the first, from the dictionary's words with their ends marked."""
    words = [w.lower() for w in re.findall("[A-Za-z]{3,}", _IDENTIFIERS) if len(set(w.lower())) > 2 and len(w) < 20]
    count, first = dict.fromkeys((a + b for a in "^abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz$"), 0.1), {}
    for w in words:
        for a, b in zip(f"^{w}", f"{w}$", strict=True):
            count[a + b] += 1
    for pair, n in count.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    return {pair: math.log2(first[pair[0]] / n) for pair, n in count.items()}


@functools.lru_cache(1 << 16)
def is_word(piece: str) -> bool:
    """Whether a run of letters reads like a word: it has vowels, few consonants in a row, and known pairs of letters."""
    low = piece.lower()
    if low in _WORDS:
        return True
    if not WORD <= len(low) <= LONGEST or not re.search("[aeiouy]", low) or re.search("[bcdfghjklmnpqrstvwxz]{5}|[aeiou]{4}|(.)\\1\\1", low):
        return False
    bits = [_pairs()[a + b] for a, b in zip(f"^{low}", f"{low}$", strict=True)]
    return sum(bits) / len(bits) <= BITS


def residue(own: str) -> str:
    """What no dictionary explains of a candidate: it is taken apart at separators, digits and changes of case; words go,
    and with them short numbers beside a word or between separators."""
    pieces = [m.group() for m in _PIECE.finditer(own)]
    word = [len(p) <= LONGEST and p.isalpha() and is_word(p) for p in pieces]
    out = []
    for i, p in enumerate(pieces):
        sides = [k for k in (i - 1, i + 1) if 0 <= k < len(pieces)]
        alone = all(not pieces[k].isalnum() for k in sides)
        short = len(p) <= (4 if p.isdigit() else 3)
        if not p.isalnum() or word[i] or short and (alone or any(word[k] for k in sides)):
            continue
        out.append(p)
    return "".join(out)


class Novelty:
    """Marginal compressed bytes of a string in its surroundings, under the identifier dictionary, over its twin's."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(_IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(
            level=12, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = (before + "\n" + after + "\n").encode("utf-8", "surrogatepass")
        bare = len(self.packer.compress(around))
        own, other = (len(self.packer.compress(around + x.encode())) - bare for x in (candidate, twin(candidate)))
        return own / max(1, other)


def is_candidate(own: str) -> bool:
    """Letters and digits, or letters that change case at a fifth of their places or more."""
    if re.search("[0-9]", own):
        return bool(re.search("[A-Za-z]", own))
    return 5 * len(re.findall("[a-z](?=[A-Z])|[A-Z](?=[a-z])", own)) >= len(own)


def base_spans(text: str, folded: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, in order."""
    out = []
    if any(x in folded for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in folded:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, folded: bytes, base: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVELTY):
    """(start, 3, end) of incompressible strings near a sensitive word."""
    if not any(x in folded for x in _HINTS):
        return []
    seen: dict[int, int] = {}
    for m in _SENSITIVE.finditer(text):
        # strings that begin near the word; each is then taken to its own end
        for c in _CANDIDATE.finditer(text, max(0, m.start() - NEAR), m.end() + NEAR + 16):
            if c.start() <= m.end() + NEAR and c.start() not in seen:
                seen[c.start()] = _REST.match(text, c.start()).end()
    out = []
    for start, end in sorted(seen.items()):
        own = text[start:end]
        if not is_candidate(own):
            continue
        if any(s < end and start < e for s, _, e in base):
            continue
        rest = residue(own)
        if len(rest) < max(RESIDUE, SHARE * len(own)) or len(rest) < len(own) and len(re.findall("[A-Za-z]", rest)) < 3:
            continue
        if novelty(text[max(0, start - CONTEXT) : start], rest, text[end : end + CONTEXT]) >= least:
            out.append((start, 3, end))
    return out


def scan(text: str | None, novelty: Novelty, least: float = NOVELTY) -> tuple[list, list]:
    """(base spans, all spans) of a text, by start, then kind."""
    if not text:
        return [], []
    folded = text.encode("utf-8", "surrogatepass").lower()
    base = base_spans(text, folded)
    return base, sorted(base + novel_spans(text, folded, base, novelty, least))


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            rows = [scan(t, novelty, least) for _, texts in portions(b.column(1)) for t in texts]
            count = [pa.array([sum(x[1] == k for x in base) for base, _ in rows], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string())
            spans = pa.array([listed(every) for _, every in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *count, digest, spans],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one), and ``size_col`` the new length."""
    place = docs.columns.index(text_col)
    length = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            columns, changed = list(b.columns), {}
            for i, text in ((at + i, t) for at, texts in portions(b.column(place)) for i, t in enumerate(texts)):
                _, spans = scan(text, novelty)
                if spans:
                    out, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    changed[i] = "".join([*out, text[at:]])
            if changed:
                texts = b.column(place).to_pylist()
                columns[place] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.string())
                if length is not None:
                    sizes = b.column(length).to_pylist()
                    columns[length] = pa.array(
                        [len(changed[i]) if i in changed else n for i, n in enumerate(sizes)], b.schema.types[length]
                    )
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
