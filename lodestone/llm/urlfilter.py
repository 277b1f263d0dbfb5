"""URL filters: all glob rules simulated at once by a bit-parallel wildcard automaton.

Each rule is a glob over the canonical URL: `*` stands for any bytes, `?` for one
byte. The symbols of all rules lie one after another in an array of 64-bit words,
a bit for each. One step of Shift-And for a byte c is

    state = (((state << 1) | start) & symbol[c]) | (state & loop)

where `loop` has the bits that a `*` follows; the shift carries from word to word.
A task steps through all URLs of a batch together, the longest first, so the work is
one pass over the bytes times the words of the rules, whatever number of rules match.

The canonical URL is `.host`, the byte FF, the path, the byte FE and the rest; no
UTF-8 text has those bytes, so a rule for a host cannot match in a path. Host: after
the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there
up to `?`, `#` or the end.

Defined results: a null url or one without `://` has an empty host and path, no rule,
and the verdict of `no_host`; of rules that match, the one with the longest text wins,
and of equally long ones the first; each row gives one row, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, map_batches

PATH_MARK, REST_MARK = b"\xff", b"\xfe"

#: Host and path rules with their verdicts.
SITE_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

#: Globs over host, path and rest that are blocked where no site rule holds.
BLOCK_GLOBS = [
    *(f"host:{name}" for name in ("ad", "ads", "adserver", "adservice", "banner", "click", "doubleclick", "pixel", "stats", "track", "tracker", "tracking")),
    *(f"path:*/{name}/*" for name in ("ads", "adserver", "advert", "adverts", "banner", "banners", "cart", "checkout", "login", "logout", "popup", "register", "signin", "signup", "sponsor", "wp-admin", "wp-login")),
    *(f"path:*/{name}.php*" for name in ("login", "register", "search", "wp-login", "xmlrpc")),
    *(f"path:*.{kind}" for kind in ("apk", "avi", "bin", "dmg", "exe", "gif", "iso", "jpg", "mp3", "mp4", "msi", "png", "rar", "torrent", "webp", "zip")),
    *(f"path:*{word}*" for word in ("casino", "porn", "viagra", "xxx-")),
    "path:*/page/????*",
    "rest:*sessionid=*",
    "rest:*phpsessid=*",
    "rest:*add-to-cart=*",
]


@dataclass(frozen=True)
class Rule:
    glob: bytes
    text: str
    verdict: str


def site_rule(text: str, verdict: str) -> Rule:
    """`example.org/es/`: that host and its subdomains, paths that start with `/es/`."""
    host, slash, path = text.partition("/")
    return Rule(b"*." + host.encode() + PATH_MARK + (slash + path).encode() + b"*", text, verdict)


def block_glob(spec: str) -> Rule:
    part, _, glob = spec.partition(":")
    inner = glob.encode()
    if part == "host":
        return Rule(b"*." + inner + b".*" + PATH_MARK + b"*", "", "block")
    if part == "path":
        return Rule(b"*" + PATH_MARK + inner + REST_MARK + b"*", "", "block")
    return Rule(b"*" + REST_MARK + inner, "", "block")


class Automaton:
    """The masks of all rules; `match` gives for each URL the rules that fit."""

    def __init__(self, globs: list[bytes]):
        symbols = [(k, glob) for k, glob in enumerate(globs)]
        width = sum(len(glob.replace(b"*", b"")) for glob in globs)
        self.words = max(1, -(-width // 64))
        make = lambda: np.zeros(self.words, dtype=np.uint64)
        self.symbol = np.zeros((256, self.words), dtype=np.uint64)
        self.begin, self.anywhere, self.loop = make(), make(), make()
        self.final: list[tuple[int, np.uint64]] = []
        at = 0  # the next free bit
        for _, glob in symbols:
            body = glob.lstrip(b"*")
            if not body.replace(b"*", b""):
                raise ValueError("a glob needs a symbol besides *")
            word, bit = at // 64, np.uint64(1 << (at % 64))
            (self.anywhere if len(body) < len(glob) else self.begin)[word] |= bit
            for c in body:
                if c == 0x2A:
                    self.loop[word] |= bit
                    continue
                word, bit = at // 64, np.uint64(1 << (at % 64))
                if c == 0x3F:
                    self.symbol[:, word] |= bit
                else:
                    self.symbol[c, word] |= bit
                at += 1
            self.final.append((word, bit))
        # a rule's last symbol must not lead on to the first of the next rule
        self.inner = ~(self.begin | self.anywhere)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Boolean [urls, rules]."""
        lengths = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls[i] for i in order), dtype=np.uint8)
        sorted_lengths = lengths[order]
        offsets = np.concatenate([[0], np.cumsum(sorted_lengths)[:-1]]).astype(np.int64)
        state = np.zeros((len(urls), self.words), dtype=np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        active = len(urls)
        for step in range(int(sorted_lengths[0]) if len(urls) else 0):
            while active and sorted_lengths[active - 1] <= step:
                active -= 1
            now = state[:active]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            shifted &= self.inner
            shifted |= self.anywhere if step else self.anywhere | self.begin
            state[:active] = (shifted & self.symbol[flat[offsets[:active] + step]]) | (now & self.loop)
        fits = np.empty((len(urls), len(self.final)), dtype=bool)
        for k, (word, bit) in enumerate(self.final):
            fits[order, k] = (state[:, word] & bit) != 0
        return fits


@lru_cache(maxsize=4)
def _automaton(globs: tuple[bytes, ...]) -> Automaton:
    """One automaton for each list of rules in a Python worker."""
    return Automaton(list(globs))


def judge(
    df: DataFrame,
    site_rules: list[tuple[str, str]] = SITE_RULES,
    block_globs: list[str] = BLOCK_GLOBS,
    url: str = "url",
    key: str = "page_id",
    default: str = "allow",
    no_host: str = "block",
) -> DataFrame:
    """(key, host, path, rule, verdict): the longest site rule that fits, else block if a glob fits, else `default`."""
    rules = sorted((site_rule(t, v) for t, v in site_rules), key=lambda r: -len(r.text))
    n_site = len(rules)
    rules += [block_glob(g) for g in block_globs]
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    value = F.coalesce(F.col(url), F.lit(""))
    parts = df.select(
        F.col(key).alias("_key"),
        ascii_lower(F.regexp_extract(value, pattern, 1)).alias("_host"),
        F.regexp_extract(value, pattern, 2).alias("_path"),
        F.regexp_extract(value, pattern, 3).alias("_rest"),
    )
    texts, verdicts = [r.text for r in rules[:n_site]], [r.verdict for r in rules[:n_site]]
    globs = tuple(r.glob for r in rules)

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        hosts, paths, rests = (batch.column(i).to_pylist() for i in (1, 2, 3))
        urls = [
            b"." + h.encode() + PATH_MARK + p.encode() + REST_MARK + r.encode()
            for h, p, r in zip(hosts, paths, rests, strict=True)
        ]
        fits = _automaton(globs).match(urls)
        site, other = fits[:, :n_site], fits[:, n_site:].any(axis=1)
        first = np.where(site.any(axis=1), site.argmax(axis=1), -1) if n_site else np.full(len(urls), -1)
        rule = [texts[k] if k >= 0 else None for k in first]
        verdict = [
            verdicts[k] if k >= 0 else "block" if bad else default if host else no_host
            for k, bad, host in zip(first, other, hosts, strict=True)
        ]
        return {
            key: batch.column(0), "host": batch.column(1), "path": batch.column(2),
            "rule": pa.array(rule, type=pa.string()), "verdict": pa.array(verdict, type=pa.string()),
        }

    kind = df.schema[key].dataType.simpleString()
    return map_batches(parts, f"{key} {kind}, host string, path string, rule string, verdict string", rows, rows=8192)
