"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed into the bits of a few 64-bit words. One Shift-And step per byte moves every rule of
every URL of a batch at once, so the work per byte does not depend on which rules match.

Globs are matched against the whole canonical URL, which is the lower-case host followed by the path:
``?`` is one byte other than ``/``, ``*`` any bytes other than ``/``, ``**`` any bytes; a backslash takes the next
character literally.

Defined results: a null URL or one without ``://`` has an empty host and path; no host rule fits it, and it is
judged by the globs like any other (none of the defaults fits an empty URL, so it is allowed). Rows are judged one
by one: repeated rows give repeated results, an empty table an empty result, long URLs are read to the end, and
columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.llm.common import ascii_lower, plain_text


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest fitting rule decides."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        text = "".join(f"\\{c}" if c in "*?\\" else c for c in self.name)
        return [f"{text}**", f"*.{text}**"]


HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
# Hosts blocked where no host rule speaks: gambling, pills, adult, advertising and spam names.
BLOCK_GLOBS = ("*casino**", "*bets.**", "*pills.**", "*adult-**", "*ads-**", "*spam-**")


class ShiftAnd:
    """Glob patterns as bit masks: bit ``j`` of a pattern says that ``j`` of its symbols have been read."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        starts = np.cumsum([0] + [len(symbols) + 1 for symbols, _ in parsed])
        self.count, self.words = len(globs), max(1, -(-int(starts[-1]) // 64))
        self.start, self.move, self.stay = self._zeros(), np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.accept = [self._bit(int(starts[p]) + len(symbols)) for p, (symbols, _) in enumerate(parsed)]
        for p, (symbols, loops) in enumerate(parsed):
            first = int(starts[p])
            self._set(self.start, first)
            for j, symbol in enumerate(symbols):
                for byte in [symbol] if symbol is not None else [b for b in range(256) if b != 0x2F]:
                    self._set(self.move[byte], first + j + 1)
            for j, crosses in loops.items():
                for byte in range(256):
                    if crosses or byte != 0x2F:
                        self._set(self.stay[byte], first + j)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        symbols: list[int | None] = []
        loops: dict[int, bool] = {}
        data, i = glob.encode(), 0
        while i < len(data):
            c = chr(data[i])
            if c == "*":
                double = data[i + 1:i + 2] == b"*"
                loops[len(symbols)] = loops.get(len(symbols), False) or double
                i += 2 if double else 1
                continue
            if c == "\\" and i + 1 < len(data):
                i += 1
                symbols.append(data[i])
            else:
                symbols.append(None if c == "?" else data[i])
            i += 1
        return symbols, loops

    def _zeros(self) -> np.ndarray:
        return np.zeros(self.words, np.uint64)

    @staticmethod
    def _bit(position: int) -> tuple[int, np.uint64]:
        return position // 64, np.uint64(1 << position % 64)

    def _set(self, mask: np.ndarray, position: int) -> None:
        word, bit = self._bit(position)
        mask[word] |= bit

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean table: one row for each text, one column for each pattern."""
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(texts) else np.zeros(0, np.int64)
        buffer, sorted_lengths = np.frombuffer(b"".join(texts), np.uint8), lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for at in range(int(lengths.max()) if len(texts) else 0):
            live = int(np.searchsorted(-sorted_lengths[:live], -at, side="left"))  # texts longer than ``at``
            byte, now = buffer[begins[:live] + at], state[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = (shifted & self.move[byte]) | (now & self.stay[byte])
        out = np.zeros((len(texts), self.count), bool)
        for p, (word, bit) in enumerate(self.accept):
            out[order, p] = (state[:, word] & bit) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = plain_text(url)
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def judge(host: Column, path: Column, rules: Sequence[HostRule] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> Column:
    """Struct of ``rule`` (name of the deciding host rule, or null) and ``verdict`` (``allow`` or ``block``)."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    globs = [g for r in ranked for g in r.globs()] + list(block_globs)
    names, verdicts = [r.name for r in ranked], [r.verdict for r in ranked]

    @F.pandas_udf("rule string, verdict string")
    def run(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        automaton = ShiftAnd(globs)
        found = automaton.match([(h + p).encode() for h, p in zip(hosts, paths)])
        rule = np.full(len(hosts), None, object)
        verdict = np.where(found[:, 2 * len(names):].any(axis=1), "block", "allow").astype(object)
        for k in range(len(names) - 1, -1, -1):  # the longest rule is written last
            fits = found[:, 2 * k] | found[:, 2 * k + 1]
            rule[fits], verdict[fits] = names[k], verdicts[k]
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    return run(host, path)


def filter_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Sequence[HostRule] = HOST_RULES,
                block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """Id, host, path, deciding rule and verdict of every row."""
    host, path = host_and_path(F.col(url_column))
    parts = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.select("page_id", "host", "path", judge(F.col("host"), F.col("path"), rules, block_globs).alias("j")).select(
        "page_id", "host", "path", "j.rule", "j.verdict")
