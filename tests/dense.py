"""The autoencoder's arithmetic on whole matrices, to hold the passes over blocks against. Without dropout, norms and branches."""

import numpy as np

from payflux.models.masked import loss_of

SLOPE = 0.2


def add_rows(n, at, values):
    out = np.zeros((n, *values.shape[1:]))
    np.add.at(out, at, values)
    return out


def gcn(p, h, src, dst):
    """src, dst: edges with one loop for each node and no others."""
    n = len(h)
    d = 1 / np.sqrt(np.maximum(np.bincount(dst, minlength=n), 1))
    weight = (d[src] * d[dst])[:, None]
    out = add_rows(n, dst, weight * (h @ p["w"])[src]) + p["b"]

    def back(g):
        dz = add_rows(n, src, weight * g[dst])
        return dz @ p["w"].T, {"w": h.T @ dz, "b": g.sum(axis=0)}

    return out, back


def gat(p, h, src, dst):
    n, (heads, width) = len(h), p["a_src"].shape
    z = (h @ p["w"]).reshape(n, heads, width)
    raw = (z * p["a_src"]).sum(-1)[src] + (z * p["a_dst"]).sum(-1)[dst]
    e = np.where(raw >= 0, raw, SLOPE * raw)
    top = np.full((n, heads), -np.inf)
    np.maximum.at(top, dst, e)
    e = np.exp(e - top[dst])
    alpha = e / add_rows(n, dst, e)[dst]
    out = add_rows(n, dst, alpha[..., None] * z[src]).reshape(n, -1) + p["b"]

    def back(g):
        gt = g.reshape(n, heads, width)
        d_alpha = (gt[dst] * z[src]).sum(-1)
        dz = add_rows(n, src, alpha[..., None] * gt[dst])
        d_raw = alpha * (d_alpha - add_rows(n, dst, alpha * d_alpha)[dst]) * np.where(raw >= 0, 1, SLOPE)
        ds, dd = add_rows(n, src, d_raw), add_rows(n, dst, d_raw)
        dz += ds[..., None] * p["a_src"] + dd[..., None] * p["a_dst"]
        flat = dz.reshape(n, -1)
        return flat @ p["w"].T, {"w": h.T @ flat, "b": g.sum(axis=0), "a_src": (ds[..., None] * z).sum(axis=0), "a_dst": (dd[..., None] * z).sum(axis=0)}

    return out, back


def linear(p, h, *_):
    return h @ p["w"] + p.get("b", 0.0), lambda g: (g @ p["w"].T, {"w": h.T @ g} | ({"b": g.sum(axis=0)} if "b" in p else {}))


def prelu(x, slope):
    return np.where(x >= 0, x, slope * x), lambda g: (np.where(x >= 0, g, slope * g), np.array([(g * np.minimum(x, 0)).sum()]))


def forward(model, x, src, dst, hidden=None):
    """The reconstruction; backward gives the gradients of all steps and of x. hidden: nodes whose latents a graph decoder doesn't see."""
    backs, h = [], x
    for step, p in zip(model.steps, model.params, strict=False):
        h, back = {"gat": gat, "gcn": gcn, "linear": linear}[step.kind](p, h, src, dst)
        act = None
        if step.activation:
            h, act = prelu(h, p["slope"])
        hides = step.at == "bridge" and hidden is not None and model.config.decoder_type in ("gat", "gcn")
        if hides:
            h = h.copy()
            h[hidden] = 0
        backs.append((back, act, hides))

    def backward(g):
        grads = []
        for back, act, hides in reversed(backs):
            own = {}
            if hides:
                g = g.copy()
                g[hidden] = 0
            if act:
                g, own["slope"] = act(g)
            g, more = back(g)
            grads.append(more | own)
        return grads[::-1], g

    return h, backward


def loss_and_gradients(model, x, src, dst, seen, masked, tokens):
    out, backward = forward(model, seen, src, dst, masked)
    value, of_masked = loss_of(model.config.loss_fn, out[masked], x[masked], model.config.alpha)
    g = np.zeros_like(out)
    g[masked] = of_masked
    grads, dx = backward(g)
    return value, [*grads, {"token": dx[tokens].sum(axis=0, keepdims=True)}]
