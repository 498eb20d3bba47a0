"""URL filter with a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed one after the other into 64-bit words: a start bit and a bit per character
each. A step over one byte is D = ((D << 1) & B[byte]) | (D & S[byte]) for all rules and all URLs of a
batch at once, with carries between words. `**` loops over any byte, `*` over any byte but `/`, `?` is
any one byte. The canonical URL is the host (A-Z lower-cased) followed by the path.

Host rules (host, path) are written as two globs each, `host/path**` and `*.host/path**`; the longest
that fits decides. URLs that fit none are blocked if a block glob fits them, else allowed.

Defined cases: null URLs and URLs without `://` have an empty host and path, fit no host rule and are
judged like the empty string; very long URLs are judged whole; of rules of equal length the first
decides; repeated rows each get their verdict; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_texts, read, utf8

#: (verdict, host, path)
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Block globs for what no host rule decides.
BLOCK_GLOBS = (
    "*spam*/**", "*casino*/**", "*cheap-pills*/**", "*free-money*/**", "*xxx*/**", "*.click/**", "*.zip/**",
    "**/wp-login*", "**/cgi-bin/**", "**.exe", "**/track/*/pixel**", "*-*-*-*-*/**",
)


#: 64-bit words of state that a batch of URLs may take together.
STATE_WORDS = 2_000_000


class Automaton:
    """Packed masks of globs; match() gives for each text which globs fit it from end to end."""

    def __init__(self, globs: Sequence[str]):
        bits = sum(len(self.tokens(g)[0]) + 1 for g in globs)
        self.words = max(1, -(-bits // 64))
        take, loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        first, self.last = np.zeros(self.words, np.uint64), []
        any_byte, in_segment = np.arange(256), np.array([b for b in range(256) if b != ord("/")])
        at = 0
        for glob in globs:
            takes, loops = self.tokens(glob)
            one = np.uint64(1 << (at % 64))
            first[at // 64] |= one
            for k in range(len(takes) + 1):
                word, bit = (at + k) // 64, np.uint64(1 << ((at + k) % 64))
                if k:
                    take[any_byte if takes[k - 1] is None else [takes[k - 1]], word] |= bit
                if loops[k]:
                    loop[any_byte if loops[k] == 2 else in_segment, word] |= bit
            at += len(takes)
            self.last.append((at // 64, np.uint64(at % 64)))
            at += 1
        self.take, self.loop, self.first = take, loop, first

    @staticmethod
    def tokens(glob: str) -> tuple[list[int | None], list[int]]:
        """Bytes to take in turn (None: any), and the loop on each state: 0, 1 within a segment, 2 any."""
        takes: list[int | None] = []
        loops = [0]
        for token in re.findall(rb"\*+|[^*]", glob.encode(), re.DOTALL):
            if token[:1] == b"*":
                loops[-1] = max(loops[-1], min(2, len(token)))
            else:
                takes.append(None if token == b"?" else token[0])
                loops.append(0)
        return takes, loops

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which globs fit each text, worked out for as many texts at a time as STATE_WORDS allows."""
        block = max(1, STATE_WORDS // self.words)
        parts = [self.matched(texts[at : at + block]) for at in range(0, len(texts), block)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.last)), bool)

    def matched(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        if len(texts) and lengths.max():
            ends = np.cumsum(lengths)
            flat = np.frombuffer(b"".join(texts), np.uint8)
            begins, falling = (ends - lengths)[order], -lengths[order]
            for at in range(int(lengths.max())):
                n = int(np.searchsorted(falling, -at, side="left"))  # texts longer than `at`
                byte, now = flat[begins[:n] + at], state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.take[byte]) | (now & self.loop[byte])
        hits = np.zeros((len(texts), len(self.last)), bool)
        for k, (word, bit) in enumerate(self.last):
            hits[order, k] = (state[:, word] >> bit) & np.uint64(1)
        return hits


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: Sequence[tuple[str, str, str]] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    after = F.when(F.instr(url_col, "://") > 0, F.substring_index(F.col(url_col), "://", 1))
    rest = F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")
    rest = F.when(after.isNotNull(), rest).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("canonical", F.concat("host", "path"))
    ranked = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    globs = [g for _, h, p in ranked for g in (f"{h}{p}**", f"*.{h}{p}**")]
    everything = [*globs, *block_globs]

    def start():
        automaton = Automaton(everything)

        def work(urls: pa.Array) -> dict[str, object]:
            rules, verdicts = [], []
            hits = automaton.match(utf8(urls))
            fits = hits[:, : len(globs)].reshape(len(urls), -1, 2).any(axis=2)
            blocked = hits[:, len(globs) :].any(axis=1)
            found = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(ranked) else 0, -1)
            for k, bad in zip(found.tolist(), blocked.tolist(), strict=True):
                rules.append(None if k < 0 else ranked[k][1] + ranked[k][2])
                verdicts.append(ranked[k][0] if k >= 0 else "block" if bad else "allow")
            return {"rule": pa.array(rules, pa.string()), "verdict": pa.array(verdicts, pa.string())}

        return work

    return map_texts(parts, "canonical", "rule string, verdict string", start, {id_col: id_col, "host": "host", "path": "path"})


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def like_regex(glob: str) -> str:
    """The same glob as a regular expression, for SQL."""
    steps = {"**": ".*", "*": "[^/]*", "?": "."}
    return "^" + "".join(steps.get(t) or re.escape(t) for t in re.findall(r"\*\*|\*|[^*]", glob)) + "$"


BLOCKED_SQL = " or ".join(f"regexp_matches(host || path, '{like_regex(g)}')" for g in BLOCK_GLOBS)
RULES_SQL = "\n".join(
    f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{{}}'".format(h + p)
    for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
)
VERDICT_SQL = " ".join(f"when '{h + p}' then '{v}'" for v, h, p in HOST_RULES)
ORACLE = f"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), ruled as (
  select *, case {RULES_SQL} end as rule from parts
)
select page_id, host, path, rule,
       case rule {VERDICT_SQL} else case when {BLOCKED_SQL} then 'block' else 'allow' end end as verdict
from ruled
"""
