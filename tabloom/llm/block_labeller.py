"""A bidirectional LSTM over the blocks of a page, in numpy: which blocks are main text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tabloom.llm.html_blocks import NUMBERS, PATH_BUCKETS, WORD_BUCKETS, Block, features

PATH_SIZE, WORD_SIZE, HIDDEN = 16, 6, 16
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
#: Steps whose gates are held at a time, and blocks of one numpy batch, with those past a page's end.
STRETCH = 512
BATCH_BLOCKS = 8192


def batches_of(lengths: list[int], limit: int = BATCH_BLOCKS) -> Iterator[range]:
    """Ranges of pages, whose lengths rise, of at most ``limit`` blocks when all are as long as the longest; a longer page is alone."""
    low = 0
    for at, length in enumerate(lengths):
        if at > low and (at + 1 - low) * length > limit:
            yield range(low, at)
            low = at
    if low < len(lengths):
        yield range(low, len(lengths))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class BlockLabeller:
    """Hashed tag paths and words are embedded and summed; two LSTMs read the sequence from both ends."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.p = {"path": draw(PATH_BUCKETS, PATH_SIZE), "word": draw(WORD_BUCKETS, WORD_SIZE)}
        for side in ("f", "b"):
            self.p[side + "x"] = draw(INPUT, 4 * HIDDEN)
            self.p[side + "h"] = draw(HIDDEN, 4 * HIDDEN)
            self.p[side + "c"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            self.p[side + "c"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.p["out"] = draw(2 * HIDDEN + INPUT)
        self.p["bias"] = np.zeros(1, dtype=np.float32)

    # A batch is its pages' blocks one after another with `place` (step, page) of each block.
    def _input(self, pages: list[list[Block]]):
        path, path_of, words, words_of, numbers = features(pages)
        counts = [np.maximum(np.bincount(o, minlength=len(numbers)), 1).astype(np.float32)[:, None] for o in (path_of, words_of)]
        x = np.zeros((len(numbers), INPUT), dtype=np.float32)
        for of, table, index, low, count in (
            (path_of, "path", path, 0, np.sqrt(counts[0])), (words_of, "word", words, PATH_SIZE, np.sqrt(counts[1]))
        ):
            size = self.p[table].shape[1]
            for k in range(size):
                x[:, low + k] = np.bincount(of, weights=self.p[table][index, k], minlength=len(numbers))
            x[:, low : low + size] /= count
        x[:, PATH_SIZE + WORD_SIZE :] = numbers
        return x, (path, path_of, words, words_of, np.sqrt(counts[0]), np.sqrt(counts[1]))

    def _walk(self, side: str, xs: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states by step for steps x pages inputs; ``mask`` is 0 past a page's end."""
        steps, pages, _ = xs.shape
        h, c = (np.zeros((pages, HIDDEN), dtype=np.float32) for _ in range(2))
        out, tape = np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
        for t in range(steps):
            if t % STRETCH == 0:  # the states go on from stretch to stretch
                gates = xs[t : t + STRETCH].reshape(-1, INPUT) @ self.p[side + "x"] + self.p[side + "c"]
                gates = gates.reshape(-1, pages, 4 * HIDDEN)
            z = gates[t % STRETCH] + h @ self.p[side + "h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tan = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((h, c, i, f, o, g, tan, m))
            c = m * new + (1 - m) * c
            h = m * (o * tan) + (1 - m) * h
            out[t] = h
        return out, tape

    @staticmethod
    def _places(lengths: list[int]):
        step = np.concatenate([np.arange(n) for n in lengths])
        page = np.repeat(np.arange(len(lengths)), lengths)
        back = np.concatenate([np.arange(n)[::-1] for n in lengths])
        return step, page, back

    def _forward(self, pages: list[list[Block]], keep: bool = False):
        lengths = [len(p) for p in pages]
        x, known = self._input(pages)
        step, page, back = self._places(lengths)
        mask = (np.arange(max(lengths))[:, None] < np.array(lengths)[None, :]).astype(np.float32)
        hidden, tapes = [], []
        for side, at in (("f", step), ("b", back)):
            xs = np.zeros((max(lengths), len(pages), INPUT), dtype=np.float32)
            xs[at, page] = x
            out, tape = self._walk(side, xs, mask, keep)
            hidden.append(out[at, page])
            tapes.append((xs, tape, at))
        joined = np.concatenate([*hidden, x], axis=1)
        chance = _sigmoid(joined @ self.p["out"] + self.p["bias"][0])
        return chance, (x, known, page, joined, tapes)

    def chances(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The chance of being main text, of every block of every page; pages must have blocks."""
        chance, _ = self._forward(pages)
        return np.split(chance, np.cumsum([len(p) for p in pages])[:-1])

    def gradients(self, pages: list[list[Block]], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        chance, (x, known, page, joined, tapes) = self._forward(pages, keep=True)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = -np.mean(np.log(np.where(labels > 0, chance, 1 - chance) + 1e-7))
        d = ((chance - labels) / len(labels)).astype(np.float32)
        grad["out"], grad["bias"][0] = joined.T @ d, d.sum()
        dj = d[:, None] * self.p["out"][None, :]
        dx = dj[:, 2 * HIDDEN :].copy()
        for n, side in enumerate("fb"):
            xs, tape, at = tapes[n]
            dout = np.zeros((*xs.shape[:2], HIDDEN), dtype=np.float32)
            dout[at, page] = dj[:, n * HIDDEN : (n + 1) * HIDDEN]
            dz_all = np.zeros((*xs.shape[:2], 4 * HIDDEN), dtype=np.float32)
            dh, dc = (np.zeros((xs.shape[1], HIDDEN), dtype=np.float32) for _ in range(2))
            for t in range(len(tape) - 1, -1, -1):
                h, c, i, f, o, g, tan, m = tape[t]
                dh = dh + dout[t]
                own = m * dh
                dnew = m * dc + own * o * (1 - tan * tan)
                dz = dz_all[t]
                dz[:, :HIDDEN] = dnew * g * i * (1 - i)
                dz[:, HIDDEN : 2 * HIDDEN] = dnew * c * f * (1 - f)
                dz[:, 2 * HIDDEN : 3 * HIDDEN] = own * tan * o * (1 - o)
                dz[:, 3 * HIDDEN :] = dnew * i * (1 - g * g)
                grad[side + "h"] += h.T @ dz
                dh = (1 - m) * dh + dz @ self.p[side + "h"].T
                dc = (1 - m) * dc + dnew * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grad[side + "x"] = xs.reshape(-1, INPUT).T @ flat
            grad[side + "c"] = flat.sum(axis=0)
            dx += dz_all[at, page] @ self.p[side + "x"].T
        path, path_of, words, words_of, path_n, word_n = known
        np.add.at(grad["path"], path, (dx[:, :PATH_SIZE] / path_n)[path_of])
        np.add.at(grad["word"], words, (dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / word_n)[words_of])
        return float(loss), grad

    def _summed(self, pages: list[list[Block]], labels: list[list[int]]) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch, made in parts if its pages are long."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        total, loss, grad = sum(map(len, pages)), 0.0, {}
        for part in batches_of([len(pages[k]) for k in order]):
            some = [order[k] for k in part]
            wanted = np.concatenate([labels[k] for k in some]).astype(np.float32)
            one, own = self.gradients([pages[k] for k in some], wanted)
            share = np.float32(len(wanted) / total)
            loss += float(share) * one
            grad = {k: share * g + grad.get(k, np.float32(0)) for k, g in own.items()}
        return loss, grad

    def fit(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> float:
        """Adam on cross entropy with a falling rate; the loss of the last epoch."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        moves, mean = 0, 0.0
        for epoch in range(epochs):
            pace = rate * (1.0 - 0.9 * epoch / epochs)
            order, losses = rng.permutation(len(pages)), []
            # Pages of like length share a batch, so that few steps are spent past a page's end.
            order = np.concatenate([sorted(order[i : i + 8 * batch], key=lambda k: len(pages[k])) for i in range(0, len(order), 8 * batch)])
            for low in rng.permutation(range(0, len(order), batch)):
                some = order[low : low + batch]
                loss, grad = self._summed([pages[i] for i in some], [labels[i] for i in some])
                losses.append(loss)
                moves += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (pace * (first[k] / (1 - 0.9**moves)) / (np.sqrt(second[k] / (1 - 0.99**moves)) + 1e-6)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean
