"""Training windows and the deep forecaster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.selection import smallest

BACK, AHEAD = 56, 28


def training_windows(grid: DataFrame, stride: int = 3, back: int = BACK, ahead: int = AHEAD) -> DataFrame:
    """(level, key, t, scale, past, future): full windows every stride days, both parts over the past's mean (at least 0.05).

    The caller owns the leak boundary: rows at or after an origin must not be in grid.
    """
    w = Window.partitionBy("level", "key").orderBy("date")
    rows = grid.withColumns({"t": F.row_number().over(w) - 1, "past": F.collect_list("y").over(w.rowsBetween(-back, -1)), "future": F.collect_list("y").over(w.rowsBetween(0, ahead - 1))})
    full = rows.where((F.size("past") == back) & (F.size("future") == ahead) & ((F.col("t") - back) % stride == 0))
    scale = F.greatest(F.aggregate("past", F.lit(0.0), lambda a, x: a + x) / back, F.lit(0.05))
    scaled = full.withColumn("scale", scale)
    return scaled.select("level", "key", "t", "scale", *[F.transform(c, lambda x: x / F.col("scale")).alias(c) for c in ("past", "future")])


class Network:
    """Residual blocks of fully connected layers: each explains part of the past and adds to the forecast.

    Trained on scaled windows with Adam, a cosine rate and the mean absolute error.
    """

    def __init__(self, back: int = BACK, ahead: int = AHEAD, blocks: int = 3, layers: int = 3, width: int = 256, seed: int = 0):
        import numpy as np

        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, (2 / a) ** 0.5, (a, b))
        self.ahead, self.layers = ahead, layers
        self.weights = []
        for _ in range(blocks):
            sizes = [back, *[width] * layers]
            block = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (init(a, b), np.zeros(b))]
            self.weights.append([*block, init(width, back) * 0.1, np.zeros(back), init(width, ahead) * 0.1, np.zeros(ahead)])

    def forward(self, x):
        import numpy as np

        tape, out = [], np.zeros((len(x), self.ahead))
        for w in self.weights:
            h, hs = x, [x]
            for k in range(self.layers):
                h = np.maximum(0, h @ w[2 * k] + w[2 * k + 1])
                hs.append(h)
            tape.append(hs)
            x = x - (h @ w[-4] + w[-3])
            out = out + h @ w[-2] + w[-1]
        return out, tape

    def gradients(self, tape, d_out):
        import numpy as np

        grads, d_x = [], 0.0
        for w, hs in zip(reversed(self.weights), reversed(tape), strict=True):
            h = hs[-1]
            d_back = -d_x if not np.isscalar(d_x) else np.zeros_like(hs[0])
            g = [h.T @ d_back, d_back.sum(0), h.T @ d_out, d_out.sum(0)]
            d = d_back @ w[-4].T + d_out @ w[-2].T
            layers = []
            for k in range(self.layers - 1, -1, -1):
                d = d * (hs[k + 1] > 0)
                layers = [hs[k].T @ d, d.sum(0), *layers]
                d = d @ w[2 * k].T
            d_x = d + (d_x if not np.isscalar(d_x) else 0.0)
            grads.insert(0, [*layers, *g])
        return grads

    def train(self, x, y, epochs: int = 12, batch: int = 512, rate: float = 1e-3, seed: int = 0):
        import numpy as np

        rng = np.random.default_rng(seed)
        m = [[np.zeros_like(w) for w in b] for b in self.weights]
        v = [[np.zeros_like(w) for w in b] for b in self.weights]
        steps, t = max(1, epochs * -(-len(x) // batch)), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                out, tape = self.forward(x[rows])
                grads = self.gradients(tape, np.sign(out - y[rows]) / out.size)
                t += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * t / steps))
                for b, gb in enumerate(grads):
                    for i, g in enumerate(gb):
                        m[b][i] = 0.9 * m[b][i] + 0.1 * g
                        v[b][i] = 0.999 * v[b][i] + 0.001 * g * g
                        self.weights[b][i] -= now * (m[b][i] / (1 - 0.9**t)) / (np.sqrt(v[b][i] / (1 - 0.999**t)) + 1e-8)
        return self


#: Windows that one network is trained on, at most: the budget is fixed, whatever the number of series.
WINDOW_BUDGET = 150_000


def fixed_stride(days: int, n_series: int, budget: int = WINDOW_BUDGET, back: int = BACK, ahead: int = AHEAD) -> int:
    """The stride that keeps windows about within the budget."""
    return max(1, (days - back - ahead) // max(1, budget // max(1, n_series)))


def sweep_arms(n_series: int, days: int, back: int = BACK, ahead: int = AHEAD) -> tuple[tuple[int, ...], int]:
    """Numbers of series up to all of them, and the windows that each arm trains on: as many as the narrowest has, at most the budget."""
    arms = tuple(sorted({max(1, n_series // 15), max(1, n_series // 3), n_series}))
    return arms, min(WINDOW_BUDGET, arms[0] * max(1, days - back - ahead + 1))


def sample_windows(windows: DataFrame, budget: int) -> DataFrame:
    """Exactly budget windows (all, if fewer): those of the smallest md5 of `key|t`, ties by key and t."""
    digest = F.md5(F.concat_ws("|", "key", F.col("t").cast("string")).cast("binary"))
    drawn = windows.withColumn("draw", F.conv(F.substring(digest, 1, 13), 16, 10).cast("double"))
    return smallest(drawn, "draw", budget, "key", "t").drop("draw")


def fit_network(windows: DataFrame, budget: int = WINDOW_BUDGET, epochs: int = 12, width: int = 256, seed: int = 0) -> Network:
    """Train on a bounded sample, in one task."""
    import pickle

    import numpy as np
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "t"])
        net = Network(width=width, seed=seed).train(np.stack(pdf["past"].to_numpy()), np.stack(pdf["future"].to_numpy()), epochs, seed=seed)
        return pd.DataFrame({"net": [pickle.dumps(net)]})

    got = sample_windows(windows, budget).select(F.lit(0).alias("model"), "key", "t", "past", "future").groupBy("model").applyInPandas(fit, "net binary").first()
    return pickle.loads(got["net"])


def forecast(histories: DataFrame, net: Network, back: int = BACK) -> DataFrame:
    """(fold, level, key, h, yhat) from history arrays ys: the last days scaled, forecast, scaled back and not negative."""
    import numpy as np
    import pandas as pd

    sent = histories.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for pdf in batches:
            x = np.stack([np.concatenate([np.zeros(max(0, back - len(v))), np.asarray(v, float)[-back:]]) for v in pdf["ys"]]) if len(pdf) else np.zeros((0, back))
            scale = np.maximum(x.mean(1, keepdims=True), 0.05)
            out = np.maximum(0, sent.value.forward(x / scale)[0] * scale)
            yield pd.DataFrame({"fold": pdf["fold"], "level": pdf["level"], "key": pdf["key"], "yhat": list(out)})

    rows = histories.select("fold", "level", "key", "ys").mapInPandas(run, "fold int, level string, key string, yhat array<double>")
    return rows.select("fold", "level", "key", F.posexplode("yhat").alias("h0", "yhat")).select("fold", "level", "key", (F.col("h0") + 1).alias("h"), "yhat")
