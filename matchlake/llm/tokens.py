"""Token ids of whole texts by the public tokenizers, inside tasks.

`word_bpe_49k.json` splits at white space before anything else, so the ids of a text are those of its white-space runs
one after another. Runs are looked up in a table of the task and only new ones are encoded, many at a time.
Texts with characters outside ASCII and Latin-1 letters, or with a special token's brackets, go to the tokenizer whole:
there, normalisation may look further than one run. Both ways give the tokenizer's own ids.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np

FOLDER = None  #: of the vocabulary files; None: where the public_tokenizers package has them
WORD_BPE = "word_bpe_49k.json"
#: Texts are taken in groups of about so many characters.
GROUP_CHARS = 2_000_000
#: Entries that a task keeps at most (about 200 bytes each); the table starts anew beyond it.
TABLE_ROWS = 700_000
#: Longer runs are encoded, but not kept.
KEPT_CHARS = 40

_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
# How the vocabulary's file splits lower-case text, here for Latin-1.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def path_of(name: str, folder: str | None = FOLDER) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _state(path: str) -> types.SimpleNamespace:
    """The tokenizer, kept for the life of a worker process, over all its tasks; and the table of its task."""
    home = sys.modules.setdefault("matchlake_worker_state", types.ModuleType("matchlake_worker_state"))
    if path not in home.__dict__:
        from tokenizers import Tokenizer

        with open(path) as f:
            plain = json.load(f)
        vocabulary = plain["model"]["vocab"]
        ends = np.zeros(max(vocabulary.values()) + 3, dtype=bool)
        ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        home.__dict__[path] = types.SimpleNamespace(whole=Tokenizer.from_file(path), words=Tokenizer.from_str(json.dumps(plain)), ends=ends, table={})
    return home.__dict__[path]


def _encode_words(state: types.SimpleNamespace, words: list[str]) -> dict[str, bytes]:
    """Ids of lower-case words without white space, as bytes: one call for all, cut where a word's last token is."""
    if not words:
        return {}
    ids = np.array(state.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
    cuts = (4 * (np.flatnonzero(state.ends[ids]) + 1)).tolist()
    raw = ids.tobytes()
    return dict(zip(words, (raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for x in texts:
        group.append(x)
        chars += len(x)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def encode(texts: Iterable[str], path: str) -> Iterator[bytes]:
    """For each text its ids, as little-endian unsigned 32-bit numbers. The table lasts as long as the texts, the tokenizer
    as long as the worker."""
    state = _state(path)
    try:
        yield from _encode(texts, state)
    finally:
        state.table = {}


def _encode(texts: Iterable[str], state: types.SimpleNamespace) -> Iterator[bytes]:
    for group in _groups(texts):
        runs = [None if _UNUSUAL.search(x) else x.lower().split() for x in group]
        table = state.table
        new = list(set().union(*(r for r in runs if r is not None)).difference(table))
        if len(table) + len(new) > TABLE_ROWS:
            table = state.table = {}
            new = list(set().union(*(r for r in runs if r is not None)))
        parts = [_SPLIT.findall(x) for x in new]
        words = _encode_words(state, list(set().union(*parts)))
        made = dict(zip(new, (b"".join(map(words.__getitem__, p)) for p in parts), strict=True))
        table.update(made)
        get = table.__getitem__
        for x, r in zip(group, runs, strict=True):
            if r is None:
                yield np.array(state.whole.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                yield b"".join(map(get, r))
        for x in new:
            if len(x) > KEPT_CHARS:
                del table[x]
