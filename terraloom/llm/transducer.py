"""A minimal acyclic transducer from sorted byte strings to their lexicographic ordinals."""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Transducer:
    """States are numbered so that targets come before the states that reach them.

    `keys` holds state * 256 + byte of every arc in ascending order, `targets` its target, `outputs`
    what it adds to the ordinal; `finals` tells which states end a term. The last state is the root.
    """

    def __init__(self, keys, targets, outputs, finals):
        self.keys, self.targets, self.outputs, self.finals = keys, targets, outputs, finals

    @classmethod
    def of(cls, terms: Iterable[bytes]) -> Transducer:
        """Built term by term; terms come in ascending order, each once.

        Only the path of the latest term is open. A state that closes is replaced by an equal one
        where there is one: equal means the same end flag, bytes and targets.
        """
        register: dict[tuple, int] = {}
        sizes: list[int] = []
        finals: list[bool] = []
        keys: list[int] = []
        targets: list[int] = []
        outputs: list[int] = []

        def close(final: bool, labels: list[int], children: list[int]) -> int:
            entry = (final, bytes(labels), tuple(children))
            state = register.get(entry)
            if state is None:
                state = register[entry] = len(sizes)
                passed = int(final)
                for label, child in zip(labels, children, strict=True):
                    keys.append(state * 256 + label)
                    targets.append(child)
                    outputs.append(passed)
                    passed += sizes[child]
                sizes.append(passed)
                finals.append(final)
            return state

        path: list[list] = [[False, [], []]]
        last = None
        for term in terms:
            shared = 0
            if last is not None:
                if term <= last:
                    raise ValueError("terms must ascend")
                while shared < len(last) and term[shared] == last[shared]:
                    shared += 1
            while len(path) - 1 > shared:
                state = close(*path.pop())
                path[-1][2].append(state)
            for byte in term[shared:]:
                path[-1][1].append(byte)
                path.append([False, [], []])
            path[-1][0] = True
            last = term
        while len(path) > 1:
            state = close(*path.pop())
            path[-1][2].append(state)
        # The root has a state of its own, so that it is the last one.
        register.clear()
        close(*path.pop())
        return cls(
            np.array(keys, np.int64),
            np.array(targets, np.int64),
            np.array(outputs, np.int64),
            np.array(finals, bool),
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, targets=self.targets, outputs=self.outputs, finals=self.finals)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        held = np.load(io.BytesIO(blob))
        return cls(held["keys"], held["targets"], held["outputs"], held["finals"])

    def ordinals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ordinals of the terms data[offsets[k]:offsets[k + 1]], -1 for those it does not hold.

        All terms advance together, a byte a step. A term leaves when it ends or no arc fits, so
        the longest term held bounds the steps, however long the terms looked up are.
        """
        starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets)
        found = np.full(len(lengths), -1, np.int64)
        going = np.arange(len(lengths))
        state = np.full(len(lengths), len(self.finals) - 1, np.int64)
        ordinal = np.zeros(len(lengths), np.int64)
        step = 0
        while len(going):
            ends = lengths[going] == step
            last = ends & self.finals[state]
            found[going[last]] = ordinal[last]
            on = ~ends
            going, state, ordinal = going[on], state[on], ordinal[on]
            if not len(going) or not len(self.keys):
                break
            key = state * 256 + data[starts[going] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[arc] == key
            going, arc = going[fits], arc[fits]
            state, ordinal = self.targets[arc], ordinal[fits] + self.outputs[arc]
            step += 1
        return found
