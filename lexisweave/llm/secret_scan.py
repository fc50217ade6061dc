"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty of strings in a sensitive context."""

from __future__ import annotations

import itertools
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import binary_column

#: The base kinds and their patterns; ASCII letters of the first group's words in either case.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Candidates of the method, and words that make what stands by them sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?i)passw|pwd|secret|token|key|credential|auth|bearer|private|signature|cert|login|salt", re.ASCII)
SENSITIVE_BYTES = (b"passw", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"private", b"signature", b"cert", b"login", b"salt")
#: What may stand between two lines of one wrapped key, and a last line that is too short to be a candidate.
WRAP = re.compile(r"""[\x20\t"'+,\\]*\r?\n[\x20\t"'+]*""")
SHORT_LINE = re.compile(r"""[A-Za-z0-9+/]{1,14}={1,2}(?![A-Za-z0-9+/_=-])""")
#: Where a statement ends, characters before a candidate in which a sensitive word counts anywhere, and those on either side in which it
#: counts within the statement.
STATEMENT, BEFORE, BESIDE = re.compile(r"[\n;]"), 48, 200
#: Characters of surroundings on each side that prime the compressor; the least marginal compressed size of a candidate, as a share of
#: that of its own characters in random order, and in bytes a character.
AROUND, NOVELTY, FLOOR = 1024, 0.92, 0.4
#: Random orders that a candidate is compared with, and its length from which a faster compressor and one order will do.
ORDERS, LONG = 3, 1 << 13
#: Where a candidate is cut into the words that names are made of.
PARTS = re.compile(r"[_/=+-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

#: What code and configuration commonly name: strings made of these compress well and are no news.
IDENTIFIERS = (
    "access account address admin alias allow api app application argument array async auth authenticate authorization available backend base64 bearer boolean branch bucket buffer build bytes cache callback "
    "certificate channel class client cluster code collection column command comment commit config configuration connection console const container content context control cookie copyright count create "
    "credential credentials current data database date debug default define delete deploy description destination development directory document domain download driver email enable encoding endpoint engine "
    "environment error event example exception execute export extension false field file filter final float folder footer format function gateway generate github global group handler hash header height host hostname "
    "html http https icon identifier image implements import include index info init input instance integer interface internal item java javascript json key label language length level library license "
    "link list load local localhost location log login long map master member memory message metadata method mode model module name namespace network node null number object offset option order output "
    "override package page parameter parent parse parser partition passphrase passwd password path payload permission pipeline placeholder policy port position prefix primary private process production "
    "profile project property protected protocol provider proxy public publish python query queue random read record redirect reference region register release remote remove replace repository request "
    "require resource response result return role root route router rule sample schema scope script search secret security select self server service session setting shared signature size source spark "
    "sql stage static status storage store stream string struct style submit subscription success suffix super switch system table tag target task template tenant test text this thread throw time timeout "
    "timestamp title token tool total transaction true type undefined unique update upload url user username users util value variable vector version view virtual void volume warning web webhook width window "
    "workflow workspace write xml yaml your_api_key your_password_here changeme ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0000000000000000 ---------------- ================ ________________"
)

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())]))

_HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns, leftmost and without overlap per kind. raw is the text in UTF-8, searched first for what a match needs."""
    out = []
    low = raw.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"apikey" in low or b"api_key" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if b"h" * 24 in raw.translate(_HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def novelty_meter() -> Callable[[bytes, str], tuple[float, float]]:
    """measure(surroundings, candidate): marginal compressed size of the candidate after its surroundings, as a share of what its own characters
    cost there in random order (on average), and in bytes a character.

    The share tells words from chance whatever the alphabet, the length and the surroundings: a key of random characters costs what any other
    order of them does, while a name is made of words that the surroundings or the dictionary of identifiers hold. Case counts for nothing, and
    candidates are cut at separators, at capitals and between letters and digits, so names match however they are written.
    """
    import zstandard as z

    names = f" {IDENTIFIERS.lower()} ".encode()
    primed = z.ZstdCompressionDict(names, dict_type=z.DICT_TYPE_RAWCONTENT)
    common = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    thorough = z.ZstdCompressionParameters.from_level(19, source_size=4096, dict_size=len(names), min_match=3, strategy=z.STRATEGY_BTULTRA, **common)
    fine, fast = z.ZstdCompressor(compression_params=thorough, dict_data=primed).compress, z.ZstdCompressor(level=3, dict_data=primed, **common).compress
    start = names[:600]  # a block that doesn't compress at all would be stored as it is

    def words(candidate: str) -> bytes:
        return f" {' '.join(filter(None, PARTS.split(candidate)))} ".lower().encode()

    def measure(around: bytes, candidate: str) -> tuple[float, float]:
        compress, orders = (fast, 1) if len(candidate) >= LONG else (fine, ORDERS)
        before = start + around.lower()
        base = len(compress(before))
        cost = lambda c: max(0, len(compress(before + words(c))) - base)
        own, others = cost(candidate), 0
        for seed in range(orders):
            mixed = list(candidate)
            random.Random(seed).shuffle(mixed)
            others += cost("".join(mixed))
        return own * orders / max(1, others), own / len(candidate)

    return measure


def looks_random(candidate: str) -> bool:
    """Whether a candidate holds letters and digits, or letters that change their case as often as by chance."""
    letters = [c for c in candidate if c.isalpha()]
    switches = sum(a.islower() != b.islower() for a, b in itertools.pairwise(letters))
    return bool(letters) and (any(c.isdigit() for c in candidate) or switches * 3 >= len(candidate))


def is_sensitive(text: str, s: int, e: int) -> bool:
    """Whether a sensitive word stands in the BEFORE characters before s, or beside s to e in the same statement."""
    if SENSITIVE.search(text, max(0, s - BEFORE), s):
        return True
    left, right = text[max(0, s - BESIDE) : s], text[e : e + BESIDE]
    return bool(SENSITIVE.search(STATEMENT.split(left)[-1]) or SENSITIVE.search(STATEMENT.split(right, maxsplit=1)[0]))


def surroundings(text: str, s: int, e: int, candidate: str) -> bytes:
    """The AROUND characters on each side of s to e, without further places of the candidate that are sensitive too: a key that is named twice is no less a key.

    Where it stands in the open, it isn't taken out: the text shows it as something that may be known.
    """
    lo, hi = max(0, s - AROUND), min(len(text), e + AROUND)
    parts, at = [], lo
    place = text.find(candidate, lo, hi)
    while place >= 0:
        end = place + len(candidate)
        if place != s and (end <= s or place >= e) and is_sensitive(text, place, end):
            parts.append((place, end))
        place = text.find(candidate, end, hi)
    out = []
    for a, b in sorted([*parts, (s, e)]):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:hi]]).encode("utf-8", "replace")


def novel_spans(text: str, raw: bytes, known: list[tuple[int, int, str]], measure: Callable[[bytes, str], tuple[float, float]], threshold: float = NOVELTY) -> list[tuple[int, int, str, float]]:
    """Candidates in a sensitive context that look random, overlap no known span and don't compress."""
    low = raw.lower()
    if not any(w in low for w in SENSITIVE_BYTES):
        return []
    out = []
    ends, starts = sorted(e for _, e, _ in known), sorted(s for s, _, _ in known)

    def measured(s: int, e: int, candidate: str) -> float | None:
        """The novelty of a candidate at s to e if it is high enough."""
        if not looks_random(candidate):
            return None
        share, size = measure(surroundings(text, s, e, candidate), candidate)
        return share if share >= threshold and size >= FLOOR else None

    free = (m.span() for m in CANDIDATE.finditer(text) if bisect_left(starts, m.end()) <= bisect_right(ends, m.start()))  # no known span starts before the end and ends after the start
    for block in _blocks(text, free):
        sensitive = [is_sensitive(text, s, e) for s, e in block]
        if not any(sensitive):
            continue
        # the lines of a wrapped key surround each other with text like their own, so they are measured as one candidate
        whole = measured(block[0][0], block[-1][1], "".join(text[s:e] for s, e in block)) if len(block) > 1 and sensitive[0] else None
        for (s, e), named in zip(block, sensitive, strict=True):
            n = whole if whole is not None else measured(s, e, text[s:e]) if named else None
            if n is not None:
                out.append((s, e, "novel", n))
        if whole is not None and (wrap := WRAP.match(text, block[-1][1])) and (tail := SHORT_LINE.match(text, wrap.end())) and bisect_left(starts, tail.end()) <= bisect_right(ends, tail.start()):
            out.append((*tail.span(), "novel", whole))
    return out


def _blocks(text: str, found: Iterable[tuple[int, int]]) -> Iterable[list[tuple[int, int]]]:
    """Candidates by blocks: lines of one length, and a last one that may be shorter, with only a line break, indents and quotes between them."""
    block: list[tuple[int, int]] = []
    for s, e in found:
        if block:
            first, last = block[0][1] - block[0][0], block[-1][1] - block[-1][0]
            if last == first >= e - s and s - block[-1][1] <= AROUND and WRAP.fullmatch(text, block[-1][1], s):
                block.append((s, e))
                continue
            yield block
        block = [(s, e)]
    if block:
        yield block


def scan_secrets(docs: DataFrame, text_col: str = "text", threshold: float = NOVELTY, result_col: str = "secrets") -> DataFrame:
    """docs with one more column, array<struct<kind, start, end, novelty>> by start and kind: what looks secret in the whole text.

    Positions are code points, end exclusive. Kinds assign, access and hex are the fixed patterns (novelty null). novel adds runs of
    16 or more key characters in a sensitive context (see is_sensitive; of a key wrapped in lines of one length, its first line, and a short padded last line goes with it)
    that look random (see looks_random) and whose marginal compressed size, after the surrounding AROUND characters on each side and a dictionary
    of identifiers, is at least `threshold` of that of the same characters in random order, and FLOOR bytes a character. A null or empty text has
    none; a very long text is searched like any other, a candidate of LONG characters with a faster compressor; repeated rows get equal spans, an empty
    table gives an empty result. result_col must not be a column of docs. Every row is finished where it is read; nothing is shuffled.
    """
    if result_col in docs.columns:
        raise ValueError(f"docs already has a column {result_col}")
    schema = T.StructType([*docs.schema.fields, T.StructField(result_col, SPANS)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind, measure = to_arrow_type(SPANS), novelty_meter()
        for batch in batches:
            found = []
            for x in binary_column(batch, text_col):
                raw = x.as_py()
                found.append(spans(raw, measure, threshold) if may_hold(raw) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, result_col])

    return docs.mapInArrow(run, schema)


def may_hold(raw: bytes) -> bool:
    """False only for texts without any span."""
    low = raw.lower()
    return any(w in low for w in SENSITIVE_BYTES) or b"AKIA" in raw or b"api" in low or b"h" * 24 in raw.translate(_HEX_MAP)


def spans(raw: bytes, measure: Callable[[bytes, str], tuple[float, float]], threshold: float = NOVELTY) -> list[dict]:
    """All spans of a text in UTF-8."""
    text = raw.decode("utf-8", "replace")
    base = base_spans(text, raw)
    found = [(s, KINDS.index(k), e, None) for s, e, k in base] + [(s, KINDS.index(k), e, n) for s, e, k, n in novel_spans(text, raw, base, measure, threshold)]
    return [{"kind": KINDS[k], "start": s, "end": e, "novelty": n} for s, k, e, n in sorted(found, key=lambda x: x[:3])]


def secret_digest(scan: DataFrame, id_col: str = "doc_id", result_col: str = "secrets") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of scan_secrets' result."""
    found = F.col(result_col)
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(found, lambda s: s["kind"] != "novel")
    return scan.select(F.col(id_col), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"), count("novel"))
