"""The masked graph autoencoder: its weights, and what one block of nodes does of a pass over the graph.

A pass stops wherever a block needs what others have: the sums over a node's neighbours (of a convolution or of
attention) or the moments of a component over all nodes (batch norm). Such a place is a sync. A block runs as far as
what it was given goes, hands over what the next sync asks for, and begins anew with the answer: states between syncs
are worked out again rather than kept. The same holds backward: gradients of answers go out, gradients of what was handed over
come in.

Sums over neighbours come from others; a node's loop is worked out where the node is, so nothing travels for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from payflux.config import ModelConfig
from payflux.functions import draws
from payflux.functions.vectors import LEAST_NORM
from payflux.models import tape
from payflux.models.tape import Value

Params = dict[str, np.ndarray]
#: Share of a batch's moments in the kept ones.
MOMENTUM = 0.1


@dataclass
class Step:
    """One layer: gat, gcn or linear, and what follows it. at: encoder, bridge or decoder."""

    kind: str
    at: str
    activation: str | None = None
    norm: str | None = None


@dataclass
class Model:
    config: ModelConfig
    width: int
    steps: list[Step] = field(default_factory=list)
    #: Of each step, and of the token ("token") at the end.
    params: list[Params] = field(default_factory=list)
    #: Of each step with a batch norm: mean and var for passes that don't train.
    moments: dict[int, Params] = field(default_factory=dict)


def xavier(rng: np.random.Generator, *shape: int) -> np.ndarray:
    bound = np.sqrt(6 / (shape[0] + shape[-1]))
    return rng.uniform(-bound, bound, shape)


def build(config: ModelConfig, width: int, seed: int = 42) -> Model:
    """A model for vectors of this width."""
    if config.encoder_type not in ("gat", "gcn"):
        raise ValueError(f"unknown encoder: {config.encoder_type}")
    if config.decoder_type not in ("gat", "gcn", "mlp", "linear"):
        raise ValueError(f"unknown decoder: {config.decoder_type}")
    if config.norm not in (None, "none", "layernorm", "batchnorm"):
        raise ValueError(f"unknown norm: {config.norm}")
    tape.activated(config.activation, Value(np.zeros((1, 1))), Value(np.zeros(1)))  # refuses unknown names
    rng = np.random.default_rng(seed)
    model = Model(config, width)
    norm = None if config.norm == "none" else config.norm

    def add(kind: str, at: str, n_in: int, n_out: int, heads: int = 1, act: str | None = None, norm: str | None = None, bias: bool = True) -> int:
        out = heads * n_out
        p: Params = {"w": xavier(rng, n_in, out)}
        if bias:
            p["b"] = np.zeros(out)
        if kind == "gat":
            p |= {"a_src": xavier(rng, heads, n_out), "a_dst": xavier(rng, heads, n_out)}
        if act == "prelu":
            p["slope"] = np.array([0.25])
        if norm:
            p |= {"gamma": np.ones(out), "beta": np.zeros(out)}
        if norm == "batchnorm":
            model.moments[len(model.steps)] = {"mean": np.zeros((1, out)), "var": np.ones((1, out))}
        model.steps.append(Step(kind, at, act, norm))
        model.params.append(p)
        return out

    n, hidden = width, 0
    for k in range(config.num_layers):
        last = k == config.num_layers - 1
        heads = 1 if last or config.encoder_type == "gcn" else config.num_heads
        n = add(config.encoder_type, "encoder", n, config.out_channels if last else config.hidden_channels, heads, config.activation, norm)
        hidden += n
    if config.residual:
        model.params[-1]["through"] = xavier(rng, width, n)
    add("linear", "bridge", hidden if config.concat_hidden else n, config.out_channels, bias=False)
    if config.decoder_type == "mlp":
        add("linear", "decoder", config.out_channels, config.hidden_channels, act=config.activation)
        add("linear", "decoder", config.hidden_channels, width)
    else:
        add(config.decoder_type, "decoder", config.out_channels, width)
        if config.residual and config.decoder_type in ("gat", "gcn"):
            model.params[-1]["through"] = xavier(rng, config.out_channels, width)
    model.params.append({"token": xavier(rng, 1, width)})
    return model


@dataclass(frozen=True)
class Draw:
    """What is drawn in a pass. Nodes are masked once for each of samples (keys of draws); without any, none is masked."""

    nodes: int
    samples: tuple[tuple[int, ...], ...] = ()
    training: bool = False

    @property
    def key(self) -> tuple[int, ...]:
        return self.samples[0] if self.samples else ()

    @property
    def times(self) -> int:
        """States of a node that pass side by side."""
        return max(1, len(self.samples))


@dataclass(frozen=True)
class Counts:
    """How many nodes are masked; of them the first become the token, the last get another node's vector."""

    masked: int
    tokens: int
    noise: int

    @staticmethod
    def of(n: int, c: ModelConfig) -> Counts:
        m = int(c.mask_rate * n)
        return Counts(m, int((1 - c.replace_rate) * m) if c.replace_rate > 0 else m, int(c.replace_rate * m))


def syncs(model: Model, training: bool) -> list[tuple[str, int]]:
    """Kind (gat, gcn, norm) and step of each sync of a pass."""
    out = []
    for k, step in enumerate(model.steps):
        if step.kind != "linear":
            out.append((step.kind, k))
        if step.norm == "batchnorm" and training:
            out.append(("norm", k))
    return out


class Waiting(Exception):
    """A pass needs the answer of its next sync."""


class Pass:
    """The pass of one block's nodes, as far as the given answers go.

    features: of the nodes ids. given: by sync, the answer without loops: places in ids of the nodes that others point to, and rows for them
    (for each sample its components; of attention greatest logits, sums of exponentials below them, weighed sums), or moments. noise: by
    sample, (places in ids, vectors). degree: of each node, loops counted.
    """

    def __init__(self, model: Model, draw: Draw, ids: np.ndarray, features: np.ndarray, given: dict[int, list[np.ndarray] | tuple[np.ndarray, np.ndarray]], noise: dict[int, tuple[np.ndarray, np.ndarray]], degree: np.ndarray | None):
        self.model, self.draw, self.ids, self.features, self.given = model, draw, ids, features, given
        self.values = [{name: Value(v) for name, v in p.items()} for p in model.params]
        self.root = None if degree is None else np.tile(1 / np.sqrt(np.maximum(degree, 1)), draw.times)[:, None]
        self.outputs: list[tuple[str, int, list[Value]]] = []
        self.leaves: list[list[Value]] = []
        #: By sync of attention: answers, greatest logits and sums of exponentials, loops counted.
        self.attention: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.embedding = self.result = None
        self.counts = Counts.of(draw.nodes, model.config)
        self.places = [draws.place(ids, draw.nodes, *key, 1) for key in draw.samples]
        self.is_masked = np.concatenate([p < self.counts.masked for p in self.places]) if draw.samples else np.zeros(len(ids), bool)
        seen = np.tile(features, (draw.times, 1))
        for s, (at, vectors) in noise.items():
            seen[s * len(ids) + at] = vectors
        try:
            first = Value(seen)
            if draw.samples:
                first = tape.with_token(seen, np.concatenate([p < self.counts.tokens for p in self.places]), self.values[-1]["token"])
            self.result = self._decoded(self._encoded(first))
        except Waiting:
            pass

    def _encoded(self, first: Value) -> Value:
        c, h, hidden = self.model.config, first, []
        for k, step in enumerate(self.model.steps):
            if step.at == "encoder":
                h = self._layer(k, self._dropped(h, k))
                hidden.append(h)
        if c.residual:
            h = tape.total(h, tape.product(first, self.values[len(hidden) - 1]["through"]))
        self.embedding = tape.joined(hidden) if c.concat_hidden else h
        return self.embedding

    def _decoded(self, h: Value) -> Value:
        bridge = next(k for k, s in enumerate(self.model.steps) if s.at == "bridge")
        h = tape.product(h, self.values[bridge]["w"])
        for k in range(bridge + 1, len(self.model.steps)):
            step, rep = self.model.steps[k], h
            if step.kind == "linear":
                h = tape.activated(step.activation, tape.shifted(tape.product(h, self.values[k]["w"]), self.values[k]["b"]), self.values[k].get("slope"))
                if k + 1 < len(self.model.steps):
                    h = self._dropped(h, k)
                continue
            rep = tape.times(h, (~self.is_masked)[:, None].astype(float))  # hidden from the neighbours
            h = self._layer(k, self._dropped(rep, k))
            if "through" in self.values[k]:
                h = tape.total(h, tape.product(rep, self.values[k]["through"]))
        return h

    def _dropped(self, h: Value, k: int) -> Value:
        rate = self.model.config.dropout if self.draw.training else 0.0
        if rate <= 0:
            return h
        return tape.times(h, (draws.uniform(*self.draw.key, 2, k, self.ids[:, None], np.arange(h.data.shape[1])) >= rate) / (1 - rate))

    def _layer(self, k: int, h: Value) -> Value:
        step, p = self.model.steps[k], self.values[k]
        if step.kind == "gcn":  # sums of what is narrower, before the product or after it
            first = p["w"].data.shape[1] <= p["w"].data.shape[0]
            z = tape.product(h, p["w"]) if first else h
            (h,) = self._sync("gcn", k, [tape.times(z, self.root)])
            h = tape.times(h, self.root)
            h = h if first else tape.product(h, p["w"])
        else:
            z = tape.product(h, p["w"])
            (h,) = self._sync("gat", k, [z, tape.by_heads(z, p["a_src"]), tape.by_heads(z, p["a_dst"])])
        h = tape.shifted(h, p["b"])
        if step.norm == "layernorm":
            h = tape.scaled(tape.row_normed(h), p["gamma"], p["beta"])
        elif step.norm == "batchnorm":
            mean, var = self._sync("norm", k, [h]) if self.draw.training else [Value(self.model.moments[k][n]) for n in ("mean", "var")]
            h = tape.scaled(tape.column_normed(h, mean, var), p["gamma"], p["beta"])
        return tape.activated(step.activation, h, p.get("slope"))

    def _sync(self, kind: str, k: int, out: list[Value]) -> list[Value]:
        at = len(self.outputs)
        self.outputs.append((kind, k, out))
        if at not in self.given:
            raise Waiting
        if kind == "norm":
            leaves = [Value(a) for a in self.given[at]]
        elif kind == "gcn":
            leaves = [Value(out[0].data + self._full(*self.given[at]), (out[0], lambda g: g))]
        else:
            leaves = [self._attended(at, k, *out)]
        self.leaves.append(leaves)
        return leaves

    def _full(self, at: np.ndarray, x: np.ndarray, empty: float = 0.0) -> np.ndarray:
        """Rows for all nodes, by sample."""
        out = np.full((len(self.ids), x.shape[1]), empty)
        out[at] = x
        return self.stacked(out)

    def _attended(self, at: int, k: int, z: Value, left: Value, right: Value) -> Value:
        """What attention gives from others and from the loops."""
        places, x = self.given[at]
        heads, rate = left.data.shape[1], self.model.config.attn_drop if self.draw.training else 0.0
        h = heads * self.draw.times
        top, den, total = self._full(places, x[:, :h], -np.inf), self._full(places, x[:, h : 2 * h]), self._full(places, x[:, 2 * h :])
        raw = left.data + right.data
        slope = np.where(raw >= 0, 1.0, self.model.config.negative_slope)
        kept = kept_copies(self.ids, self.ids, np.ones(len(self.ids)), heads, rate, *self.draw.key, 4, k) / (1 - rate) if rate > 0 else np.ones(raw.shape)
        above = np.maximum(top, raw * slope)
        less, own = np.exp(top - above), np.exp(raw * slope - above)
        den = den * less + own
        cube = lambda v: v.reshape(len(v), heads, -1)
        answer = ((cube(total) * less[..., None] + cube(z.data) * (own * kept)[..., None]) / den[..., None]).reshape(z.data.shape)
        self.attention[at] = answer, above, den
        alpha = own / den

        def to_logit(g: np.ndarray) -> np.ndarray:
            return alpha * (kept * (cube(z.data) * cube(g)).sum(-1) - (cube(answer) * cube(g)).sum(-1)) * slope

        return Value(answer, (z, lambda g: (cube(g) * (alpha * kept)[..., None]).reshape(g.shape)), (left, to_logit), (right, to_logit))

    # --- rows by sample, and samples side by side ---

    def stacked(self, x: np.ndarray) -> np.ndarray:
        """Of each node its samples side by side -> the samples' matrices one after the other."""
        n, s = len(self.ids), self.draw.times
        return x if s == 1 else x.reshape(n, s, -1).transpose(1, 0, 2).reshape(n * s, -1)

    def abreast(self, x: np.ndarray) -> np.ndarray:
        n, s = len(self.ids), self.draw.times
        return x if s == 1 else x.reshape(s, n, -1).transpose(1, 0, 2).reshape(n, -1)

    # --- gradients ---

    def loss(self) -> tuple[float, np.ndarray]:
        """This block's part of the loss over all masked nodes, and its gradient by the result."""
        at, g = self.is_masked, np.zeros_like(self.result.data)
        if not at.any():
            return 0.0, g
        c = self.model.config
        value, g[at] = loss_of(c.loss_fn, self.result.data[at], self.features[at], c.alpha)
        share = at.sum() / self.counts.masked
        return value * share, g * share

    def backward(self, seeds: dict[int, list[np.ndarray]]) -> None:
        """Gradients of the leaves and weights, from that of the loss and, by sync, those of what was handed over."""
        all_seeds = [(self.result, self.loss()[1])]
        for at, gradients in seeds.items():
            kind, _, out = self.outputs[at]
            if kind == "norm":  # gradients of the moments, over all nodes
                mean, var = gradients
                x = out[0].data
                all_seeds.append((out[0], (mean + 2 * var * (x - self.leaves[at][0].data)) / self.draw.nodes))
            else:
                all_seeds.extend(zip(out, gradients, strict=True))
        tape.accumulated(all_seeds)

    def gradients(self) -> dict[str, np.ndarray]:
        zero = lambda v: v.gradient if v.gradient is not None else np.zeros_like(v.data)
        return {f"{k}.{name}": zero(v) for k, p in enumerate(self.values) for name, v in p.items()}


def loss_of(kind: str, x: np.ndarray, y: np.ndarray, alpha: float = 2.0) -> tuple[float, np.ndarray]:
    """Loss of the reconstruction x of y, and its gradient (of the cosine loss 0 for rows of x without a direction)."""
    if kind == "mse":
        return float(((x - y) ** 2).mean()), 2 * (x - y) / x.size
    if kind != "sce":
        raise ValueError(f"unknown loss: {kind}")
    nx, ny = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), LEAST_NORM) for v in (x, y))
    cos = ((x / nx) * (y / ny)).sum(axis=1, keepdims=True)
    # a reconstruction of norm 0 has no direction: its gradient would be a division by the least norm and drown all others
    g = np.where(nx > LEAST_NORM, -alpha * (1 - cos) ** (alpha - 1) / len(x), 0.0)
    return float(((1 - cos) ** alpha).mean()), g * (y / ny - cos * x / nx) / nx


def errors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - cosine of the rows; 1 where either is zero."""
    nx, ny = (np.maximum(np.linalg.norm(v, axis=1), LEAST_NORM) for v in (x, y))
    return 1 - (x * y).sum(axis=1) / (nx * ny)


# --- links -----------------------------------------------------------------------------------

#: Bytes of messages that are in memory at a time.
AT_ONCE = 32 << 20
COPIES = 1 << 20


def summed(at: np.ndarray, n: int, width: int, rows) -> np.ndarray:
    """By each of n places, the sum of the rows for it. at: places, ascending; rows(a, b): the rows of links a to b."""
    out, step = np.zeros((n, width)), max(1, AT_ONCE // (8 * width))
    for a in range(0, len(at), step):
        here = at[a : a + step]
        new = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        out[here[new]] += np.add.reduceat(rows(a, a + len(here)), new, axis=0)
    return out


def kept_copies(src: np.ndarray, dst: np.ndarray, n: np.ndarray, heads: int, rate: float, *keys: int) -> np.ndarray:
    """Of the n parallel edges of each link, how many are kept, for each head. Each is drawn on its own."""
    last = np.cumsum(n.astype(np.int64))
    out = np.zeros((len(n), heads))
    for a in range(0, int(last[-1]) if len(last) else 0, COPIES):
        copy = np.arange(a, min(a + COPIES, int(last[-1])))
        link = np.searchsorted(last, copy, "right")
        kept = draws.uniform(*keys, src[link][:, None], dst[link][:, None], (last[link] - copy)[:, None], np.arange(heads)) >= rate
        for h in range(heads):
            out[:, h] += np.bincount(link, kept[:, h], len(n))
    return out


class Links:
    """The links of one cell: src, dst (sorted by dst) and n, how many edges they stand for, without those that are dropped."""

    def __init__(self, model: Model, draw: Draw, src: np.ndarray, dst: np.ndarray, n: np.ndarray):
        self.model, self.draw = model, draw
        rate = model.config.drop_edge_rate if draw.training else 0.0
        if rate > 0:
            own = src == dst
            n = np.where(own, n, kept_copies(src, dst, np.where(own, 0, n), 1, rate, *draw.key, 3)[:, 0])
            src, dst, n = src[n > 0], dst[n > 0], n[n > 0]
        self.src, self.dst, self.n = src, dst, n
        self.sources, self.s = np.unique(src, return_inverse=True)
        self.targets, self.t = np.unique(dst, return_inverse=True)
        self.by_source = np.argsort(self.s, kind="stable")

    def degrees(self) -> np.ndarray:
        return np.bincount(self.t, self.n, len(self.targets))[:, None]

    def spread(self, z: np.ndarray, backward: bool = False) -> np.ndarray:
        """Sums of the sources' rows by target, or the other way round."""
        if backward:
            o = self.by_source
            return summed(self.s[o], len(self.sources), z.shape[1], lambda a, b: z[self.t[o[a:b]]] * self.n[o[a:b], None])
        return summed(self.t, len(self.targets), z.shape[1], lambda a, b: z[self.s[a:b]] * self.n[a:b, None])

    def _kept(self, k: int, heads: int) -> np.ndarray:
        """By link and head, the share of parallel edges that dropout leaves, over its mean."""
        rate = self.model.config.attn_drop if self.draw.training else 0.0
        if rate <= 0:
            return np.ones((len(self.n), heads))
        return kept_copies(self.src, self.dst, self.n, heads, rate, *self.draw.key, 4, k) / (self.n[:, None] * (1 - rate))

    def attend(self, k: int, z: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """By target: the greatest logit, the sum of exponentials below it, and the sources' rows weighed by them (by heads)."""
        heads = left.shape[1]
        raw = left[self.s] + right[self.t]
        logit = np.where(raw >= 0, raw, self.model.config.negative_slope * raw)
        first = np.flatnonzero(np.concatenate([[True], self.t[1:] != self.t[:-1]]))
        top = np.maximum.reduceat(logit, first, axis=0) if len(first) else np.zeros((0, heads))
        weight = self.n[:, None] * np.exp(logit - top[self.t])
        den = np.add.reduceat(weight, first, axis=0) if len(first) else top
        weight *= self._kept(k, heads)
        weighed = lambda a, b: (z[self.s[a:b]].reshape(b - a, heads, -1) * weight[a:b, :, None]).reshape(b - a, -1)
        return np.concatenate([top, den, summed(self.t, len(self.targets), z.shape[1], weighed)], axis=1)

    def attend_back(self, k: int, z: np.ndarray, left: np.ndarray, right: np.ndarray, top: np.ndarray, den: np.ndarray, g: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the sources' rows and logits, and of the targets' logits. along: by target, its gradient times its sum, by heads."""
        heads = left.shape[1]
        raw = left[self.s] + right[self.t]
        slope = self.model.config.negative_slope
        alpha = self.n[:, None] * np.exp(np.where(raw >= 0, raw, slope * raw) - top[self.t]) / den[self.t]
        kept = self._kept(k, heads)
        dots, step = np.empty((len(raw), heads)), max(1, AT_ONCE // (8 * z.shape[1]))
        for a in range(0, len(raw), step):
            b = a + step
            dots[a:b] = (z[self.s[a:b]] * g[self.t[a:b]]).reshape(len(raw[a:b]), heads, -1).sum(-1)
        d_raw = alpha * (kept * dots - along[self.t]) * np.where(raw >= 0, 1, slope)
        o, weight = self.by_source, alpha * kept
        sent = lambda a, b: (g[self.t[o[a:b]]].reshape(b - a, heads, -1) * weight[o[a:b], :, None]).reshape(b - a, -1)
        dz = summed(self.s[o], len(self.sources), z.shape[1], sent)
        d_left = summed(self.s[o], len(self.sources), heads, lambda a, b: d_raw[o[a:b]])
        return dz, d_left, summed(self.t, len(self.targets), heads, lambda a, b: d_raw[a:b])
