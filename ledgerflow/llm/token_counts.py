"""Token counts by a tokenizer that is compiled to finite-state transducers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerflow.llm.common import slices, texts_of
from ledgerflow.llm.transducer import Splitter

#: Transitions and word counts that a worker keeps; beyond that it starts anew.
KEPT_TRANSITIONS, KEPT_WORDS = 500_000, 300_000
#: Words up to this length are remembered with their counts.
REMEMBERED = 40
#: Texts of these characters alone are in form NFC already and are lower-cased alike by any library.
PLAIN = re.compile("[\x00-ɏ‐-‧]*")


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the rest for U+0100 and following."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class CountTransducer:
    """Byte-pair merges as a deterministic transducer whose transitions carry emitted-token counts.

    After every prefix of a word the last token of the prefix's encoding is determined: it is the one vocabulary entry
    that ends there and keeps its place beside the last token of what precedes it. A state therefore is the longest
    suffix that begins some vocabulary entry, with the last tokens at each place in it; nothing before it can matter.
    States are made as words need them. A transition's weight is the change in the prefix's token count, so a
    word's count is the sum along its path; the word's end, which has symbols of its own, closes it.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix, self.ranks = suffix, {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.tokens = set(vocab)
        self.inner, self.final = set(), set()
        for t in self.tokens:
            whole = t.removesuffix(suffix) if suffix and t.endswith(suffix) and t != suffix else t
            (self.final if whole is not t else self.inner).add(whole)
        self.begins = {t[:i] for t in self.inner | self.final for i in range(1, len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.pairs.clear()
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.states: list[tuple[str, tuple, tuple]] = [("", (None,), (0,))]
        self.ids = {self.states[0][:2] + self.states[0][2:]: 0}

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of a sequence of symbols by its merges, lowest rank first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str, final: bool) -> list[str]:
        return [*token[:-1], token[-1] + self.suffix] if final else [*token]

    def _stands(self, last: str | None, token: str, final: bool) -> bool:
        """Whether token keeps its place after last (None: at the word's begin)."""
        key = (last, token, final)
        if (known := self.pairs.get(key)) is None:
            whole = token + self.suffix if final else token
            left = [] if last is None else [last]
            self.pairs[key] = known = self.merge(self._symbols(last or "", False) + self._symbols(token, final)) == [*left, whole]
        return known

    def _ending(self, state: int, symbol: str, final: bool) -> tuple[str, int]:
        """The last token once symbol has been read, and the count by then against the count before."""
        suffix, last, count = self.states[state]
        text, known = suffix + symbol, self.final if final else self.inner
        for at in range(len(text)):
            if (token := text[at:]) in known and self._stands(last[at], token, final):
                return token, count[at] + 1
        raise ValueError(f"no token ends with {symbol!r}")

    def _step(self, state: int, symbol: str) -> tuple[int, int]:
        token, change = self._ending(state, symbol, False)
        suffix, last, count = self.states[state]
        text, cut = suffix + symbol, 0
        while cut < len(text) and text[cut:] not in self.begins:
            cut += 1
        made = (text[cut:], (*last, token)[cut:], tuple(c - change for c in (*count, change)[cut:]))
        if (to := self.ids.get(made)) is None:
            to = self.ids[made] = len(self.states)
            self.states.append(made)
        self.steps[state, symbol] = to, change
        return to, change

    def count(self, word: str) -> int:
        """Tokens of a word of byte symbols."""
        if len(self.steps) > KEPT_TRANSITIONS:
            self.clear()
        state = total = 0
        steps = self.steps
        for symbol in word[:-1]:
            state, change = steps.get((state, symbol)) or self._step(state, symbol)
            total += change
        end = (state, word[-1] + self.suffix)
        if (known := steps.get(end)) is None:
            known = steps[end] = 0, self._ending(state, word[-1], True)[1]
        return total + known[1]


class _Counts(dict):
    def __init__(self, transducer: CountTransducer):
        self.transducer, self.symbols = transducer, byte_symbols()

    def __missing__(self, word: str) -> int:
        n = self.transducer.count("".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]))
        if len(word) <= REMEMBERED:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


class CompiledTokenizer:
    """Counts tokens of texts; compiled from a tokenizer file with word-end merges and the splitting pattern of Splitter(joined=False).

    Two transducers in a row. The splitter's has few states, so its chunks' state maps compose by a prefix scan, which gives the
    words' places whatever the text's length. The merges' has states made as words need them and carries the emitted-token
    counts; a word begins it anew, so what its chunks would pass on is nothing but a count, and the counts of words add up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = Splitter(joined=False)
        self.counts = _Counts(CountTransducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or ""))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A special string inside a text is one token and parts what stands around it."""
        n = np.zeros(len(texts), np.int64)
        ready = []
        for i, t in enumerate(texts):
            if "<|" in t:
                t, n[i] = self.special.subn(" ", t)
            ready.append(t.lower() if PLAIN.fullmatch(t) else self.normalizer.normalize_str(t))
        ends = np.cumsum([len(t) + 1 for t in ready])
        joined = " ".join(ready) + " "
        starts, stops = self.splitter.split(joined, ends - 1)
        words = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        found = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))
        return n + np.bincount(np.searchsorted(ends, starts, side="right"), weights=found, minlength=len(texts)).astype(np.int64)


@cache
def compiled(path: str) -> CompiledTokenizer:
    return CompiledTokenizer(path)


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit: n_tokens > limit), one row per input row.

    tokenizer: name of a file in the installed public_tokenizers package, which every executor has. Null texts count
    as empty: 0 bytes, 0 tokens. Texts are read whole; rows that repeat or have no doc_id get a row each; an empty
    table gives an empty one. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tokens = compiled(public_tokenizers.path(tokenizer))
        for ids, texts in slices(batches):
            n = tokens.count([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
