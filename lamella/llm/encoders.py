"""Encoding whole texts with a `tokenizers` vocabulary, each distinct word of a run of texts once.

A text is cut where no token can cross: before a space between two other non-space characters (byte-level vocabularies), or at
ASCII white space (vocabularies that drop it).  Arrow splits a run of texts and numbers its distinct units; units not met
before are encoded by the library, and the ids of all texts are gathered from those of their units.  Of a unit that is a word of
Latin letters with marks after it, word and marks are encoded apart, as the vocabularies' patterns part them; such words need
neither normalisation nor patterns, and go to the same model without these steps.  Texts that the cut does not suit, or that
hold the string of a special token, are encoded whole, so that ids are always those of a plain call of the library.
"""

from __future__ import annotations

import codecs
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that are kept from run to run; of more, those that the last run did not meet are forgotten.
CACHE = 400_000
#: Bytes of text in a run.
RUN = 12 << 20
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks that part from letters before them in both kinds of vocabularies; the apostrophe may not.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = f"^[{LETTERS}]+[!-&(-/:-@\\[-`{{-~]*$"


class Encoder:
    """ids of texts.  Slots number what has been encoded; slot 0 has no ids, -1 is a unit at which a text may not be cut."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        drops = json.dumps(norm or {}).find('"\\\\s+"') >= 0 and pre.get("type") == "Sequence"
        spaced = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.kind = "drop" if drops else "space" if spaced else "whole"
        self.lead = " " if spaced else ""
        # the same model, for words that are one piece each; the first or last token of a piece shows where it begins or ends
        suffix, self.words = model.get("end_of_word_suffix"), None
        if spaced or drops and suffix:
            self.words = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}}))
            self.edge = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.edge[[i for t, i in model["vocab"].items() if (t.startswith("Ġ") if spaced else t.endswith(suffix))]] = True
            level = ByteLevel(add_prefix_space=False, use_regex=False)  # its characters for the bytes of other letters than ASCII
            bytes_as = list(map(chr, range(256)))
            for c in map(chr, range(0xC0, 0x100)):
                for b, as_ in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                    bytes_as[b] = as_
            self.bytes_as = "".join(bytes_as)
        self._clear()

    def _clear(self) -> None:
        self.values, self.n_values = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1
        # units by name, and the slot of each
        self.names, self.slot_of = pa.array([], pa.string()), np.zeros(0, np.int64)
        # what has no white space before it
        self.bare: dict[str, int] = {}

    def _add(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New slots for ids one after another."""
        n, v = self.n + len(sizes), self.n_values + len(values)
        for name, need in (("values", v), ("start", n), ("size", n)):
            have = getattr(self, name)
            if need > len(have):
                grown = np.zeros(max(need, 2 * len(have)), have.dtype)
                grown[: len(have)] = have
                setattr(self, name, grown)
        self.values[self.n_values : v] = values
        self.size[self.n : n] = sizes
        self.start[self.n : n] = self.n_values + np.cumsum(sizes) - sizes
        slots = np.arange(self.n, n)
        self.n, self.n_values = n, v
        return slots

    def _name(self, names: pa.Array, slots: np.ndarray) -> None:
        self.names, self.slot_of = pa.concat_arrays([self.names, names]), np.concatenate([self.slot_of, slots])

    def _known(self, units: pa.Array) -> np.ndarray:
        """The slot of each unit, -2 where it is not met yet."""
        if not len(self.names):
            return np.full(len(units), -2)
        at = np.asarray(pc.fill_null(pc.index_in(units, value_set=self.names), -1), np.int64)
        return np.where(at >= 0, self.slot_of[at], -2)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """ids of slots one after another."""
        out, done = np.zeros(int(self.size[at].sum()), "<u4"), 0
        for a in range(0, len(at), 1 << 19):
            own = at[a : a + (1 << 19)]
            size = self.size[own]
            end = np.cumsum(size)
            n = int(end[-1])
            out[done : done + n] = self.values[np.arange(n) + np.repeat(self.start[own] - end + size, size)]
            done += n
        return out

    def _keep(self, names: pa.Array, slots: np.ndarray) -> None:
        """Forget all but these units."""
        ok = slots > 0
        names, slots = names.filter(pa.array(ok)), slots[ok]
        values, sizes = self._gather(slots), self.size[slots]
        self._clear()
        self._name(names, self._add(values, sizes))

    def _plainly(self, texts: list[str]) -> np.ndarray:
        """Slots of texts that the library encodes one by one."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return self._add(np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes)

    def _simply(self, words: pa.Array) -> np.ndarray:
        """Slots of words of Latin letters."""
        n, lead = len(words), "Ġ" if self.lead else ""
        cut = pa.array([*range(0, n, 512), n], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(cut, words.cast(pa.binary())), b" ").to_pylist()
        texts = [lead + codecs.charmap_decode(t, "strict", self.bytes_as)[0].replace(" ", " " + lead) for t in texts]
        values = np.concatenate([np.asarray(e.ids, "<u4") for e in self.words.encode_batch_fast(texts, add_special_tokens=False)])
        edge = np.flatnonzero(self.edge[values])
        if len(edge) != n:  # the edges are those of pieces; be exact all the same
            return self._plainly([self.lead + w for w in words.to_pylist()])
        return self._add(values, np.diff(edge, append=len(values)) if lead else np.diff(edge, prepend=-1))

    def _find(self, names: list[str]) -> np.ndarray:
        """Slots of strings as they are, with nothing before them."""
        if len(self.bare) > 100_000:
            self.bare.clear()
        new = [u for u in names if u not in self.bare]
        if new:
            self.bare.update(zip(new, self._plainly(new).tolist(), strict=True))
        return np.fromiter(map(self.bare.__getitem__, names), np.int64, len(names))

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Encode units that are not met yet; their slots."""
        slots = np.zeros(len(units), np.int64)
        plain = np.asarray(pc.match_substring_regex(units, _PLAIN)) if self.words else np.zeros(len(units), bool)
        odd = ~plain
        if self.kind == "space":
            bad = odd & np.asarray(pc.or_(pc.equal(units, ""), pc.not_equal(units, pc.utf8_trim_whitespace(units))))
            slots[bad] = -1
            odd &= ~bad
        if odd.any():
            slots[odd] = self._plainly([self.lead + u for u in units.filter(pa.array(odd)).to_pylist()])
        self._name(units.filter(pa.array(~plain)), slots[~plain])
        if not plain.any():
            return slots
        words = units.filter(pa.array(plain))
        core = pc.utf8_rtrim(words, MARKS)
        core = (pc.utf8_lower(core) if self.kind == "drop" else core).dictionary_encode()
        own = self._known(core.dictionary)
        fresh = pa.array(own == -2)
        if pc.any(fresh).as_py():
            new = core.dictionary.filter(fresh)
            own[np.asarray(fresh)] = self._simply(new)
            self._name(new, own[np.asarray(fresh)])
        cores = own[np.asarray(core.indices)]
        tail = pc.replace_substring_regex(words, f"^[{LETTERS}]+", "").dictionary_encode()
        tails = np.asarray([self._find([m])[0] if m else 0 for m in tail.dictionary.to_pylist()], np.int64)[np.asarray(tail.indices)]
        made = np.where(tails > 0, 0, cores)
        left = np.flatnonzero(tails)
        if len(left):
            made[left] = self._add(self._gather(np.stack([cores[left], tails[left]], 1).ravel()), self.size[cores[left]] + self.size[tails[left]])
        other = np.asarray(pc.not_equal(words, core.dictionary_decode()))
        self._name(words.filter(pa.array(other)), made[other])
        slots[plain] = made
        return slots

    def _slots(self, flat: pa.Array) -> np.ndarray:
        """The slot of each unit."""
        coded = flat.dictionary_encode()
        own = self._known(coded.dictionary)
        new = own == -2
        if new.any():
            own[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        if len(self.names) > CACHE:
            self.last = coded.dictionary, own
        return own[np.asarray(coded.indices)]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, first place of each text's and the number of all); null counts as empty.

        ``end`` is appended to each text's ids.
        """
        n, self.last = len(texts), None
        if texts.null_count:
            texts = texts.fill_null("")
        whole = np.full(n, self.kind == "whole")
        for s in self.special:
            whole |= np.asarray(pc.match_substring(texts, s))
        cut = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        parts = pc.ascii_split_whitespace(cut) if self.kind == "drop" else pc.split_pattern(cut, " ")
        off, flat = np.asarray(parts.offsets).astype(np.int64), parts.flatten()
        off -= off[0] if len(off) else 0
        if self.kind == "whole" or not len(flat):
            at = np.zeros(len(flat), np.int64)
        elif self.kind == "drop":
            at = self._slots(flat)
        else:
            first, rest = off[:-1], np.ones(len(flat), bool)
            rest[first] = False
            at = np.zeros(len(flat), np.int64)
            at[rest] = self._slots(flat.filter(pa.array(rest)))
            head = flat.take(pa.array(first)).dictionary_encode()
            names, code = head.dictionary.to_pylist(), np.asarray(head.indices)
            at[first] = self._find(names)[code]
            loose = np.fromiter((not h or h[-1].isspace() for h in names), bool, len(names))[code]
            # a cut next to white space is none
            whole |= loose & (np.diff(off) > 1) | (np.bincount(np.searchsorted(off, np.flatnonzero(at < 0), "right") - 1, minlength=n) > 0)
            at[np.repeat(whole, np.diff(off))] = 0
        ids, size = self._gather(at), np.concatenate([[0], np.cumsum(self.size[at])])
        first = size[off] if n else np.zeros(1, np.int64)
        if whole.any():
            ids, first = self._with_whole(texts, whole, ids, first)
        if end is not None:
            ends = first[1:] + np.arange(n)
            out = np.full(len(ids) + n, end, "<u4")
            keep = np.ones(len(out), bool)
            keep[ends] = False
            out[keep] = ids
            ids, first = out, first + np.arange(n + 1)
        if self.last:
            self._keep(*self.last)
        pa.default_memory_pool().release_unused()
        return ids, first

    def _with_whole(self, texts: pa.Array, whole: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, parts, at = np.diff(first), [], 0
        for r in np.flatnonzero(whole).tolist():
            own = np.asarray(self.tok.encode(texts[r].as_py(), add_special_tokens=False).ids, "<u4")
            parts += [ids[at : first[r]], own]
            at, size[r] = first[r], len(own)
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(size)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that tasks share what was encoded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def runs(batches, max_bytes: int = RUN):
    """Arrow batches with a column ``text`` as tables of about ``max_bytes`` of text, with one chunk a column."""
    held, size = [], 0

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = int(sizes[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + max_bytes - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(sizes[hi - 1]) - done
            lo = hi
            if size >= max_bytes or lo < batch.num_rows:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()
