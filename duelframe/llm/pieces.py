"""A vocabulary of scored pieces in a double-array trie, and lattices over many short texts at once.

`Pieces` is built on the driver from a SentencePiece model file (its size is the vocabulary's) and broadcast. All texts
are cut into chunks no piece can cross: a run of the space marker with what follows it, or an isolated control
character. A lattice over a whole text is the product of its chunks' lattices, so best path and sum over all paths of a
text follow from those of its distinct chunks.
"""

import re

import numpy as np
import sentencepiece

MARK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
UNKNOWN_PENALTY = 10.0
# Log scores are multiples of this, so that sums are exact in any order and equal sums are real ties.
GRID = 1 / 1024


def marked(text: str) -> str:
    """Spaces as markers, with the marker that stands before every text."""
    return MARK + text.replace(" ", MARK) if text else ""


class Pieces:
    """Surfaces, log scores and the trie. Stored scores are taken as they are if they are log probabilities (Unigram
    models); a rank-scored model (BPE) gets Zipf log scores of its ranks."""

    def __init__(self, surfaces: list, scores: np.ndarray, in_trie: np.ndarray, byte_ids: dict, unknown: int):
        self.surfaces, self.scores, self.byte_ids, self.unknown = surfaces, scores, byte_ids, unknown
        self.unknown_score = float(scores[in_trie].min()) - UNKNOWN_PENALTY if in_trie.any() else -UNKNOWN_PENALTY
        self.decoded = [surface.replace(MARK, " ").encode() for surface in surfaces]
        for byte, piece in byte_ids.items():
            self.decoded[piece] = bytes([byte])
        members = [i for i in np.nonzero(in_trie)[0].tolist() if surfaces[i]]
        self._build({surfaces[i]: i for i in reversed(members)})
        crossing = any(s[k] != MARK and s[k + 1] == MARK for s in (surfaces[i] for i in members) for k in range(len(s) - 1))
        lone = "".join(c for c in "\n\r\t" if not any(c in surfaces[i] and len(surfaces[i]) > 1 for i in members))
        plain = f"[^{MARK}{lone}]"
        self.chunk_pattern = "(?s).+" if crossing else f"[{lone}]|{MARK}+{plain}*|{plain}+" if lone else f"{MARK}+{plain}*|{plain}+"

    @classmethod
    def load(cls, model_file: str) -> "Pieces":
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        count = model.vocab_size()
        surfaces = [model.id_to_piece(i) for i in range(count)]
        stored = np.array([model.get_score(i) for i in range(count)])
        bytes_of = {int(BYTE.fullmatch(surfaces[i])[1], 16): i for i in range(count) if model.is_byte(i)}
        usable = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(count)])
        ranked = bool(usable.any()) and bool((stored[usable] == np.round(stored[usable])).all())
        if ranked:
            rank = np.empty(count)
            rank[np.argsort(-stored, kind="stable")] = np.arange(count)
            odds = -np.log(rank + 2)
            scores = odds - np.log(np.exp(odds[usable]).sum())
        else:
            scores = stored
        return cls(surfaces, np.round(scores / GRID) * GRID, usable, bytes_of, model.unk_id())

    def _build(self, members: dict):
        """base, check and value: from state s, character code c leads to t = base[s] + c if check[t] == s."""
        counts: dict = {}
        tree = [{}]
        ends = [-1]
        for surface, piece in members.items():
            at = 0
            for c in surface:
                counts[c] = counts.get(c, 0) + 1
                nxt = tree[at].get(c)
                if nxt is None:
                    nxt = tree[at][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = piece
        code = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
        base, check, value, taken = [0] * len(tree), {0: -2}, {}, {0}
        slot, slots, high, free = {0: 0}, {}, 1, 1
        for node in range(len(tree)):  # parents come before their children
            s = slots[node] = slot.pop(node)
            value[s] = ends[node]
            codes = sorted(code[c] for c in tree[node])
            if not codes:
                continue
            while free in taken:
                free += 1
            # A single child fills the first gap it can; siblings try a few places and else go behind all others.
            b = max(1, free - codes[0])
            for _ in range(200 if len(codes) < 3 else 20):
                if not any(b + c in taken for c in codes):
                    break
                b += 1
            else:
                b = max(1, high - codes[0])
            base[node] = b
            for c, child in tree[node].items():
                t = b + code[c]
                taken.add(t)
                check[t] = s
                slot[child] = t
            high = max(high, b + codes[-1] + 1)
        size = high + 1
        arrays = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for node, s in slots.items():
            arrays[0][s], arrays[1][s], arrays[2][s] = base[node], check[s], value[s]
        base, check, value = arrays
        top = len(code) + 2  # a step from any state stays inside the arrays; an unknown character has the last code
        self.base, self.check, self.value = (np.concatenate([x, np.full(top, -1, np.int32)]) for x in (base, check, value))
        self.points = np.array(sorted(ord(c) for c in code), np.uint32)
        self.codes = np.array([code[chr(p)] for p in self.points], np.int32)
        self.no_code = len(code) + 1
        self.deepest = max(map(len, members), default=0)

    def lattice(self, chunks: list) -> "Lattice":
        return Lattice(self, chunks)


class Lattice:
    """All occurrences of pieces in `chunks`, laid end to end; node p of the flat array is the point before character p
    of a chunk, and each chunk has one more node after its last character."""

    WINDOW = 4096

    def __init__(self, pieces: Pieces, chunks: list):
        self.pieces = pieces
        self.points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.array([len(c) for c in chunks], np.int64)
        owner = np.repeat(np.arange(len(chunks)), self.lengths)
        first_char = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if len(chunks) else np.empty(0, np.int64)
        self.local = np.arange(len(self.points)) - first_char[owner]
        self.last = (first_char + self.lengths)[owner]
        self.node = np.arange(len(self.points)) + owner  # of each character
        self.first = first_char + np.arange(len(chunks))
        self.final = self.first + self.lengths
        self.nodes = len(self.points) + len(chunks)
        if len(pieces.points):
            at = np.minimum(np.searchsorted(pieces.points, self.points), len(pieces.points) - 1)
            self.code = np.where(pieces.points[at] == self.points, pieces.codes[at], pieces.no_code)
        else:
            self.code = np.full(len(self.points), pieces.no_code)

    def steps(self):
        """(start nodes, end nodes, pieces) by rising start within the chunks, all chunks at once; no two edges of a step
        share an end. Piece -1 is one character that no one-character piece covers."""
        longest = int(self.lengths.max()) if len(self.lengths) else 0
        for low in range(0, longest, self.WINDOW):
            chars = np.arange(len(self.points)) if longest <= self.WINDOW else np.nonzero((self.local >= low) & (self.local < low + self.WINDOW))[0]
            starts, ends, ids = self._edges(chars)
            order = np.argsort(self.local[starts], kind="stable")
            starts, ends, ids = starts[order], ends[order], ids[order]
            cuts = np.searchsorted(self.local[starts], np.arange(low, min(low + self.WINDOW, longest) + 1))
            begin, length = self.node[starts], ends - starts
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield begin[a:b], begin[a:b] + length[a:b], ids[a:b]

    def _edges(self, chars):
        p = self.pieces
        found, single = [], np.zeros(len(self.points), bool)
        alive, state = chars, np.zeros(len(chars), np.int32)
        for depth in range(p.deepest):
            inside = alive + depth < self.last[alive]
            alive, state = alive[inside], state[inside]
            to = p.base[state] + self.code[alive + depth]
            good = p.check[to] == state
            alive, state = alive[good], to[good]
            if not len(alive):
                break
            ids = p.value[state]
            hit = ids >= 0
            found.append((alive[hit], alive[hit] + depth + 1, ids[hit]))
            if depth == 0:
                single[alive[hit]] = True
        bare = chars[~single[chars]]
        found.append((bare, bare + 1, np.full(len(bare), -1, np.int32)))
        return (np.concatenate(side) for side in zip(*found))

    def best(self):
        """Viterbi: (flat piece ids, offsets by chunk, score by chunk). Of equal scores the longer last piece wins."""
        p = self.pieces
        score = np.full(self.nodes, -np.inf)
        score[self.first] = 0.0
        back, via = np.full(self.nodes, -1, np.int64), np.full(self.nodes, -1, np.int32)
        for start, end, ids in self.steps():
            new = score[start] + np.where(ids >= 0, p.scores[ids], p.unknown_score)
            better = new > score[end]
            end = end[better]
            score[end], back[end], via[end] = new[better], start[better], ids[better]
        chunk, at = np.arange(len(self.first)), self.final
        steps = []
        while len(chunk):
            open_ = at > self.first[chunk]
            chunk, at = chunk[open_], at[open_]
            steps.append((chunk, via[at], back[at]))
            at = back[at]
        owner = np.concatenate([s[0] for s in steps[::-1]]) if steps else np.empty(0, np.int64)
        ids = np.concatenate([s[1] for s in steps[::-1]]) if steps else np.empty(0, np.int32)
        begin = np.concatenate([s[2] for s in steps[::-1]]) if steps else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        owner, ids, begin = owner[order], ids[order], begin[order]
        ids, owner = self._fallback(ids, owner, begin)
        return ids, np.searchsorted(owner, np.arange(len(self.first) + 1)), score[self.final]

    def _fallback(self, ids, owner, begin):
        """Uncovered characters become their UTF-8 bytes, or the unknown piece in a model without bytes."""
        bare = np.nonzero(ids < 0)[0]
        if not len(bare):
            return ids, owner
        spelled = [[self.pieces.byte_ids.get(b, self.pieces.unknown) for b in chr(c).encode("utf-8", "surrogatepass")] if self.pieces.byte_ids else [self.pieces.unknown]
                   for c in self.points[begin[bare] - owner[bare]].tolist()]
        repeat = np.ones(len(ids), np.int64)
        repeat[bare] = [len(s) for s in spelled]
        where = np.repeat(ids < 0, repeat)
        ids, owner = np.repeat(ids, repeat), np.repeat(owner, repeat)
        ids[where] = [b for s in spelled for b in s]
        return ids, owner

    def uncovered(self, begin):
        """Characters (as code points) at the given nodes' edges of piece -1."""
        return self.points[begin - np.searchsorted(self.first, begin, side="right") + 1]
