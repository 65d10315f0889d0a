"""Model files: mixtures, chains of states and transitions, networks, clusters; and the network's configuration.

Files are small and written by the driver. The text layouts round priors to seven digits; parquet keeps them whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np

from tessel.functions.activations import ALPHA_TANH, BETA_TANH
from tessel.operators.cluster import Clusters
from tessel.operators.hmm import Chain, Hmm, Registry, State, normalise_transitions, registry
from tessel.operators.mixture import Mixture, derive
from tessel.operators.neural import Layer, Network, Settings, layer


def _row(values, width: int) -> str:
    return " ".join(f"{v:{width}.8e}" for v in values)


# --- mixtures ---------------------------------------------------------------------------------------------------------


def save_mixture(m: Mixture, prefix: str) -> str:
    """Writes <prefix>-<components>.txt; a file of that name becomes .bak."""
    path = f"{prefix}-{m.n_components:04d}.txt"
    if os.path.exists(path):
        os.replace(path, f"{path[:-4]}.bak")
    with open(path, "w") as f:
        f.write(f"n_components {m.n_components}\ndim {m.dim}\ncovar_type {m.covariance}\n")
        for prior, mu, sigma in zip(m.priors, m.mu, m.sigma):
            f.write(f"priori {prior:e}\nmean {_row(mu, 16)}\nsigma \n")
            f.writelines(_row(r, 16) + "\n" for r in sigma)
    return path


def load_mixture(path: str, min_var: float = 1e-5) -> Mixture:
    tokens = iter(open(path).read().split())
    head: dict[str, str] = {}
    priors, mu, sigma = [], [], []
    for t in tokens:
        if t in ("n_components", "dim", "covar_type"):
            head[t] = next(tokens)
        elif t == "priori":
            priors.append(float(next(tokens)))
        elif t in ("mean", "sigma"):
            d = int(head["dim"])
            n = d if t == "mean" else d * d
            (mu if t == "mean" else sigma).append([float(next(tokens)) for _ in range(n)])
    d = int(head["dim"])
    if len(priors) != int(head["n_components"]):
        raise ValueError(f"{path}: {len(priors)} components, {head['n_components']} announced")
    return derive(Mixture(head["covar_type"], np.array(priors), np.array(mu), np.array(sigma).reshape(-1, d, d), min_var))


# --- chains -----------------------------------------------------------------------------------------------------------


def _transitions_text(name: str, a: np.ndarray) -> str:
    return f'~t "{name}"\n<TRANSP> {len(a)}\n' + "".join("  " + _row(r, 15) + "\n" for r in a)


def _state_text(name: str, s: State) -> str:
    head = f'~s "{name}"\n' + (f"<GINDEX> {s.index}\n" if s.index is not None and s.index >= 0 else "") + f"<PRIOR> {s.prior:e}\n"
    if s.mixture is None:
        return head + f"<B> {len(s.emissions)}\n{_row(s.emissions, 17)}\n<NUMMIXES> 0\n"
    m = s.mixture
    parts = [f"<MIXTURE> {c + 1}\n<GCONST> {_row([m.priors[c], m.log_dets[c]], 17)}\n<MEAN> {m.dim}\n{_row(m.mu[c], 17)}\n<VARIANCE> {m.dim}\n{_row(np.diag(m.sigma[c]), 17)}\n" for c in range(m.n_components)]
    return head + f"<NUMMIXES> {m.n_components}\n" + "".join(parts)


def _chain_text(name: str, chain: Chain, n: int, first: int) -> str:
    states = "".join(f'<STATE> {k + 1 + first}\n~s "{s}"\n' for k, s in enumerate(chain.states))
    return f'~h "{name}"\n<BEGINHMM>\n<NUMSTATES> {n}\n{states}~t "{chain.transitions}"\n<ENDHMM>\n'


def save_registry(r: Registry, states: str, transitions: str, chains: str) -> None:
    """States, transitions and chains in tagged lines, each in the order of names; the three paths may be files of their own, or one: what a chain names comes before it."""
    first = 1 if r.left_to_right else 0
    texts = {path: "" for path in (transitions, states, chains)}
    texts[transitions] += "".join(_transitions_text(n, r.transitions[n]) for n in sorted(r.transitions))
    texts[states] += "".join(_state_text(n, r.states[n]) for n in r.ordered())
    texts[chains] += "".join(_chain_text(n, c, len(r.transitions[c.transitions]), first) for n, c in sorted(r.chains.items()))
    for path, text in texts.items():
        with open(path, "w") as f:
            f.write(text)


def load_registry(*paths: str, left_to_right: bool = False, terminal: bool = False) -> Registry:
    """What save_registry writes, of one file or several, read in this order. Transitions are normalised again; mixtures of states are diagonal."""
    matrices: dict[str, np.ndarray] = {}
    states: dict[str, dict] = {}
    chains: dict[str, Chain] = {}
    state: dict = {}
    for path in paths:
        with open(path) as f:
            tokens: Iterator[str] = iter(re.findall(r'"[^"]*"|\S+', f.read()))
        inside, name, title, places = False, "", "", {}
        place = 0
        for t in tokens:
            if t in ("~t", "~s", "~h"):
                name = next(tokens).strip('"')
                if t == "~s" and inside:
                    places[place] = name
                elif t == "~s":
                    state = states[name] = {"mix": []}
                elif t == "~h":
                    title = name
            elif t == "<BEGINHMM>":
                inside, places = True, {}
            elif t == "<STATE>":
                place = int(next(tokens))
            elif t == "<ENDHMM>":
                chains[title], inside = Chain(tuple(places[k] for k in sorted(places)), name), False
            elif t == "<TRANSP>":
                n = int(next(tokens))
                matrices[name] = np.array([float(next(tokens)) for _ in range(n * n)]).reshape(n, n)
            elif t == "<GINDEX>":
                state["index"] = int(next(tokens))
            elif t == "<PRIOR>":
                state["prior"] = float(next(tokens))
            elif t == "<B>":
                state["b"] = np.array([float(next(tokens)) for _ in range(int(next(tokens)))])
            elif t == "<GCONST>":
                state["mix"].append([float(next(tokens))])
                next(tokens)
            elif t in ("<MEAN>", "<VARIANCE>"):
                state["mix"][-1].append([float(next(tokens)) for _ in range(int(next(tokens)))])
            elif t in ("<NUMMIXES>", "<MIXTURE>", "<NUMSTATES>"):
                next(tokens)
    mixture = lambda mix: Mixture("diagonal", np.array([c[0] for c in mix]), np.array([c[1] for c in mix]), np.array([np.diag(c[2]) for c in mix])) if mix else None
    named = {n: State(s.get("prior", 1.0), s.get("b"), mixture(s["mix"]), s.get("index")) for n, s in states.items()}
    return Registry(named, {n: normalise_transitions(a, left_to_right) for n, a in matrices.items()}, chains, left_to_right, terminal)


def save_hmm(h: Hmm, path: str) -> None:
    """Transitions, states and the chain that names them, in one file of tagged lines."""
    save_registry(registry(h), path, path, path)


def load_hmm(path: str, left_to_right: bool = False, terminal: bool = False) -> Hmm:
    """The one chain of a file that save_hmm wrote; transitions are normalised again. Mixtures of states are diagonal."""
    found = load_registry(path, left_to_right=left_to_right, terminal=terminal)
    return found.model(next(iter(found.chains)))


# --- clusters and networks --------------------------------------------------------------------------------------------


def save_clusters(clusters: Clusters, path: str | None) -> None:
    """A JSON file; without a path nothing is written."""
    if path is not None:
        with open(path, "w") as f:
            json.dump({"centres": clusters.centres.tolist(), "J": clusters.J, "steps": clusters.steps}, f)


def load_clusters(path: str) -> Clusters | None:
    """None if there is no such file."""
    if not os.path.exists(path):
        return None
    with open(path) as f:
        x = json.load(f)
    return Clusters(np.array(x["centres"]), x["J"], x["steps"])


def save_network(net: Network, directory: str, suffix: str | None = None) -> str:
    os.makedirs(directory, exist_ok=True)
    path = f"{directory}/net-{net.name}{f'-{suffix}' if suffix else ''}.npz"
    arrays, heads = {}, []
    for k, l in enumerate(net.layers):
        heads.append({n: v for n, v in l.__dict__.items() if not isinstance(v, np.ndarray)})
        arrays |= {f"{k}-{n}": v for n, v in l.__dict__.items() if isinstance(v, np.ndarray)}
    np.savez_compressed(path, head=json.dumps({"settings": asdict(net.settings), "layers": heads}), **arrays)
    return path


def load_network(name: str, directory: str) -> Network | None:
    """The file without a suffix, or with best or 3, whichever is there first; None if none is."""
    for suffix in ("", "-best", "-3"):
        path = f"{directory}/net-{name}{suffix}.npz"
        if os.path.exists(path):
            with np.load(path) as x:
                head = json.loads(str(x["head"]))
                layers = [Layer(**{**h, **{n.split("-", 1)[1]: x[n] for n in x.files if n.split("-", 1)[0] == str(k)}}) for k, h in enumerate(head["layers"])]
            return Network(tuple(layers), Settings(**head["settings"]), name)
    return None


def read_network_config(path: str, name: str = "network", seed: int = 0) -> Network:
    """key value lines and layer size activation kept-share learning-rate [noise] lines; # starts a comment. The first layer line is the input.

    num_layers must be the number of layer lines; other slopes of tanh than the fixed ones, and rates tuned on line, are refused.
    """
    settings, rows, announced = Settings(seed=seed), [], None
    # fixed values: the only slopes of tanh that layers have
    fixed = {"alpha_tanh": ALPHA_TANH, "beta_tanh": BETA_TANH}
    truth = lambda s: s.lower() in ("true", "1", "yes")
    keys = {"learning_rate": ("learning_rate", float), "momentum": ("momentum", float), "l2_penalty": ("l2", float), "c_max_norm": ("max_norm", float), "max_iter": ("max_iter", int),
            "add_input_noise": ("add_noise", truth), "add_noise": ("add_noise", truth), "batch_size": ("batch_size", int), "batch_normalisation": ("batch_normalisation", truth), "scale": ("scale", float)}
    with open(path) as f:
        for line in f:
            words = line.split("#")[0].split()
            if not words:
                continue
            if words[0] == "layer":
                rows.append((int(words[1]), words[2], *map(float, words[3:])))
            elif words[0] in keys:
                attribute, kind = keys[words[0]]
                settings = replace(settings, **{attribute: kind(words[1])})
            elif words[0] == "num_layers":
                announced = int(words[1])
            elif words[0] in fixed:
                if abs(float(words[1]) - fixed[words[0]]) > 1e-3:
                    raise ValueError(f"{path}: {words[0]} is {fixed[words[0]]}, not {words[1]}")
            elif words[0] == "olr_iterations":
                if int(words[1]) > 0:
                    raise ValueError(f"{path}: rates are not tuned on line; olr_iterations must be 0 or below")
            else:
                raise ValueError(f"{path}: unknown key {words[0]}")
    if announced is not None and announced != len(rows):
        raise ValueError(f"{path}: {len(rows)} layers, {announced} announced")
    rng, layers = np.random.default_rng(seed), []
    for (a, before, *_), (b, kind, *rest) in zip(rows, rows[1:]):
        keep, rate, noise = (rest + [1.0, settings.learning_rate, 0.0][len(rest) :])[:3]
        layers.append(layer(a, b, kind, rng, settings.scale, input_kind=before, keep=keep, learning_rate=rate, noise=noise))
    return Network(tuple(layers), settings, name)
