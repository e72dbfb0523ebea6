"""Template scores and classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutplan.functions.frames import mean_abs_diff, value
from cutplan.operators.segments import BLOCK, blocked
from cutplan.sources.bands import band_columns, band_rows
from cutplan.sources.work import work_dir

# Template categories, and the value of a category without a score.
CTYPES = ("pause", "speed_1x", "speed_2x", "speed_0_2x")
NO_SCORE = -1.0


def frame_diff(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """B1: adds `diff`, the mean absolute difference to the frame before as float, 0 for the first.

    Pixels are dealt in blocks of frames, so no task has more than a block of a video.
    """
    before = F.lag("gray").over(W.partitionBy("video_id", "_block").orderBy("frame_idx"))
    made = blocked(frames, block).withColumn("diff", F.coalesce(mean_abs_diff(F.col("gray"), before), F.lit(0.0)).cast("float"))
    return made.where("_own").drop("_block", "_own")


def template_mask(t: Column) -> Column:
    """Pixels above 10 count."""
    return F.transform(t, lambda p: p > 10)


def prepared(templates: DataFrame) -> DataFrame:
    """Adds `tz`, the template less its masked mean and 0 off the mask, its norm `tn` and its pixel count `tc`."""
    on = F.zip_with("t", "m", lambda t, m: F.when(m, t.cast("double")))
    count = F.aggregate("m", F.lit(0), lambda n, m: n + F.when(m, 1).otherwise(0))
    mean = F.try_divide(F.aggregate(on, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), count)
    out = templates.withColumn("tc", count).withColumn("_mean", mean)
    out = out.withColumn("tz", F.transform(on, lambda x: F.coalesce(x - F.col("_mean"), F.lit(0.0)))).drop("_mean")
    return out.withColumn("tn", F.aggregate("tz", F.lit(0.0), lambda s, x: s + x * x))


def correlation(patch: Column, m: Column, tz: Column, tn: Column, tc: Column) -> Column:
    """Pearson correlation of the masked pixels; null where one side doesn't vary.

    The template is centred already, so the patch's mean drops out of the product.
    """
    # one pass for the product, the sum and the sum of squares of the patch's masked pixels
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"))
    cells = F.arrays_zip(patch.alias("p"), tz.alias("z"), m.alias("m"))
    sums = F.aggregate(
        cells,
        zero,
        lambda a, c: F.when(
            c["m"], F.struct((a["xy"] + c["p"] * c["z"]).alias("xy"), (a["x"] + c["p"]).alias("x"), (a["xx"] + c["p"] * c["p"]).alias("xx"))
        ).otherwise(a),
        lambda a: F.try_divide(a["xy"], F.sqrt(F.greatest(F.lit(0.0), tn * (a["xx"] - F.try_divide(a["x"] * a["x"], tc))))),
    )
    return sums


#: Templates that one pass takes; more are taken in blocks.
MAX_TEMPLATES = 1000


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """B2 on joined rows of a frame (w, h, gray) and a prepared template: adds score, x and y of the best
    placement, the first in row order of equals.  Rows whose region can't hold the template go."""
    w = F.least(F.col("w") - F.col("roi_x"), F.col("roi_w"))
    h = F.least(F.col("h") - F.col("roi_y"), F.col("roi_h"))
    fits = pairs.withColumn("_nx", w - F.col("tw") + 1).withColumn("_ny", h - F.col("th") + 1).where("_nx > 0 AND _ny > 0")

    def patch(place: Column) -> Column:
        x, y = F.col("roi_x") + F.pmod(place, F.col("_nx")), F.col("roi_y") + F.floor(place / F.col("_nx")).cast("int")
        row = lambda r: F.slice("gray", ((y + r) * F.col("w") + x + 1).cast("int"), F.col("tw"))
        return F.when(F.col("th") == 1, row(F.lit(0))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.col("th") - 1), row)))

    def score(place: Column) -> Column:
        r = correlation(patch(place), F.col("m"), F.col("tz"), F.col("tn"), F.col("tc"))
        return F.struct(F.when(F.isnan(r) | (F.abs(r) == float("inf")), None).otherwise(r).alias("score"), (-place).alias("place"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), (F.col("_nx") * F.col("_ny") - 1).cast("int")), score))
    done = fits.withColumn("_best", best).withColumn("score", F.col("_best.score"))
    x = F.col("roi_x") + F.pmod(-F.col("_best.place"), F.col("_nx"))
    y = F.col("roi_y") + F.floor(-F.col("_best.place") / F.col("_nx")).cast("int")
    return done.withColumn("x", x).withColumn("y", y)


SCORES = "video_id long, frame_idx long, ctype string, template_id int, score double, x int, y int"
#: Pixels of frames that the kernel holds at once, and the largest matrix that it makes of a template.
KERNEL_PIXELS = 1 << 16
MATRIX_CELLS = 1 << 20
#: Single precision holds all whole numbers up to this one.
WHOLE = 1 << 24
Rect = tuple[int, int, int, int]


def cropped(rect: Rect, binary: bool) -> Column:
    """The pixels of a frame (w, h, gray) inside x0, y0, x1, y1, clamped to the frame, row by row."""
    x0, y0, x1, y1 = (F.lit(v) for v in rect)
    cols, rows = F.least("w", x1) - x0, F.least("h", y1) - y0
    if binary:
        row = lambda r: F.substring("gray", (F.lit(r) * F.col("w") + x0 + 1).cast("int"), cols)
        lines = [F.when(F.col("h") > r, row(r)).otherwise(F.lit(b"")) for r in range(rect[1], rect[3])]
        return F.when((cols > 0) & (rows > 0), F.concat(*lines)).otherwise(F.lit(b""))
    line = lambda r: F.slice("gray", (r * F.col("w") + x0 + 1).cast("int"), cols)
    part = F.flatten(F.transform(F.sequence(y0, y0 + rows - 1), line))
    whole = F.slice("gray", (y0 * F.col("w") + 1).cast("int"), F.col("w") * rows)
    return F.when((cols <= 0) | (rows <= 0), F.slice("gray", 1, 0)).when((cols == F.col("w")), whole).otherwise(part)


def cropped_bands(rect: Rect, rows: int, names: list[str]) -> Column:
    """The same from columns of bands of `rows` rows each; only bands that the rectangle meets are read."""
    x0, y0, x1, y1 = rect
    cols = F.least("w", F.lit(x1)) - x0
    row = lambda r: F.substring(names[r // rows], (F.lit(r % rows) * F.col("w") + x0 + 1).cast("int"), cols)
    lines = [F.when(F.col("h") > r, row(r)).otherwise(F.lit(b"")) for r in range(y0, min(y1, rows * len(names)))]
    return F.when((cols > 0) & (F.col("h") > y0), F.concat(*lines)).otherwise(F.lit(b"")) if lines else F.lit(b"")


def _fast(n: int) -> int:
    """The least length of at least n without prime factors above 5."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def shifted(t: np.ndarray, width: int) -> np.ndarray:
    """[th * width, nx]: the template's rows at every horizontal place, so that th rows of a picture in one
    line times this are its sums at all horizontal places."""
    th, tw = t.shape
    out = np.zeros((th, width, width - tw + 1))
    for x in range(width - tw + 1):
        out[:, x : x + tw, x] = t
    return out.reshape(th * width, -1)


def separable(parts: list[tuple[np.ndarray, np.ndarray]], h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """[w, k * nx] and [ny, h * k]: a sum of k products of a column and a row, as two matrices that give its
    sums at all placements in a picture of h x w, along rows first and then along columns."""
    th, tw, k = len(parts[0][0]), len(parts[0][1]), len(parts)
    ny, nx = h - th + 1, w - tw + 1
    along, down = np.zeros((w, k, nx), np.float32), np.zeros((ny, h, k), np.float32)
    columns, rows = (np.array(side).T for side in zip(*parts, strict=True))
    for x in range(nx):
        along[x : x + tw, :, x] = rows
    for y in range(ny):
        down[y, y : y + th] = columns
    return along.reshape(w, k * nx), down.reshape(ny, h * k)


#: A coarse pass leaves at most this part of a template's norm out, or there is none; what single precision may
#: add; the part of a patch's squares that its spread must have for a coarse score to count.
COARSE_REST, COARSE_SLACK, COARSE_SPREAD = 0.3, 5e-3, 1e-3
#: Most products of a column and a row in a coarse pass, and most candidates of it among all placements (one in ...).
COARSE_PARTS, COARSE_SHARE = 6, 8


class Template:
    """A template's pixels, centred, with its mask and what is made of them for a width of pictures."""

    def __init__(self, t: np.ndarray, on: np.ndarray):
        self.height, self.width, self.count, self.full = *t.shape, int(on.sum()), bool(on.all())
        self.z = np.where(on, t - (t[on].sum() / self.count if self.count else 0.0), 0.0)
        self.on, self.norm = on.astype(np.float64), float((self.z * self.z).sum())
        self.made: dict[tuple, np.ndarray] = {}

    def __reduce__(self) -> tuple:
        return Template, (self.z, self.on > 0)

    def _parts(self, pixels: np.ndarray, rest: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
        """The leading products of a column and a row of some pixels, and the part of their norm that they leave out, at most `rest`."""
        u, s, v = np.linalg.svd(pixels, full_matrices=False)
        left = np.sqrt(np.maximum(0.0, np.cumsum((s * s)[::-1])[::-1])) / max(np.sqrt((s * s).sum()), 1e-300)
        k = max(1, int((left > rest).sum()))
        return [(u[:, i] * s[i], v[i]) for i in range(k)], float(left[k]) if k < len(left) else 0.0

    def coarse(self, h: int, w: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], float] | None:
        """The matrices of a coarse pass for the template and for its mask, and the part of the norm left out; None where it wouldn't pay."""
        key = ("coarse", h, w)
        if key not in self.made:
            (z, rest), (on, lost) = self._parts(self.z, COARSE_REST), self._parts(self.on, 1e-9)
            pays = len(z) + 2 * len(on) <= COARSE_PARTS + 2 and lost < 1e-9 and self.norm > 0
            self.made[key] = (separable(z, h, w), separable(on, h, w), rest) if pays else None
        return self.made[key]

    def matrix(self, name: str, width: int, kind: type) -> np.ndarray:
        key = (name, width, kind)
        if key not in self.made:
            parts = [self.z if part == "z" else self.on for part in name.split()]
            self.made[key] = np.concatenate([shifted(p, width) for p in parts], axis=1).astype(kind)
        return self.made[key]


class Pictures:
    """A region of some frames, [n, h, w], with what the scores of several templates share.

    Sums over placements come from matrix products, in single precision where pixels are whole bytes, or
    from a Fourier transform where the template's matrix would be large; sums of boxes from integral images.
    Bytes are taken less a whole number near their mean, so their sums under a mask are whole numbers too,
    which single precision holds exactly up to `WHOLE`; beyond that double precision is taken.  `best` scores
    bytes coarsely first and exactly where the coarse score leaves it open.
    """

    def __init__(self, region: np.ndarray):
        self.exact, self.kind = region.dtype.kind in "iu", np.float32 if region.dtype == np.uint8 else np.float64
        self.region, self.shape = region, region.shape
        self.kept: dict[str, np.ndarray] = {}

    @property
    def raw(self) -> np.ndarray:
        # sums of squared bytes of a small region fit into 32 bits
        narrow = self.region.dtype == np.uint8 and self.shape[1] * self.shape[2] < 1 << 15
        return self._made("raw", lambda: self.region.astype(np.int32 if narrow else np.float64))

    @property
    def size(self) -> tuple[int, int]:
        return _fast(self.shape[1]), _fast(self.shape[2])

    def _made(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def _values(self, name: str) -> np.ndarray:
        """`even`: pixels less their mean, a whole number for bytes, `raw`: pixels; `even square`, `square`: their squares."""

        def even() -> np.ndarray:
            if self.kind is np.float32:
                mean = self.region.reshape(len(self.region), -1).mean(1, dtype=np.float32)
                return np.subtract(self.region, np.rint(mean)[:, None, None], dtype=np.float32)
            return self.raw - self.raw.mean((1, 2), keepdims=True)

        def squares(name: str) -> np.ndarray:
            return np.square(self._values(name))

        if name == "raw":
            return self.raw
        return self._made(name, even if name == "even" else lambda: squares("even" if name == "even square" else "raw"))

    def _reach(self) -> float:
        """The largest of the pixels less their mean, without its sign."""
        return self._made("reach", lambda: float(np.abs(self._values("even")).max(initial=0)))

    def _lines(self, name: str, th: int, kind: type) -> np.ndarray:
        """[n * ny, th * w]: th rows in one line, from each row on."""

        def make() -> np.ndarray:
            v = np.ascontiguousarray(self._values(name), kind)
            n, h, w = v.shape
            view = np.lib.stride_tricks.as_strided(v, (n, h - th + 1, th * w), (v.strides[0], v.strides[1], v.strides[2]))
            return view.reshape(n * (h - th + 1), th * w)

        return self._made(f"{name} {th} {np.dtype(kind)}", make)

    def _placed(self, name: str, t: Template, parts: str, kind: type) -> list[np.ndarray]:
        """[n, ny, nx] sums of the values times the template's pixels (part z) or its mask (part on), for each part."""
        n, h, w = self.raw.shape
        ny, nx = h - t.height + 1, w - t.width + 1
        if t.height * w * nx <= MATRIX_CELLS:
            sums = self._lines(name, t.height, kind) @ t.matrix(parts, w, kind)
            return [sums[:, k * nx : (k + 1) * nx].reshape(n, ny, nx) for k in range(len(parts.split()))]
        spectrum = self._made(f"{name} spectrum", lambda: np.fft.rfft2(self._values(name).astype(np.float64), self.size))
        made = [np.fft.rfft2(t.z if part == "z" else t.on, self.size) for part in parts.split()]
        return [np.fft.irfft2(spectrum * np.conj(m), self.size)[:, :ny, :nx] for m in made]

    def _boxes(self, name: str, th: int, tw: int) -> np.ndarray:
        """Sums of all th x tw boxes."""

        def integral() -> np.ndarray:
            v = self._values(name)
            out = np.zeros((len(v), v.shape[1] + 1, v.shape[2] + 1), v.dtype)
            np.cumsum(v, axis=1, out=out[:, 1:, 1:])
            return np.cumsum(out, axis=2, out=out)

        c = self._made(f"{name} integral", integral)
        down = c[:, th:] - c[:, :-th]
        return down[:, :, tw:] - down[:, :, :-tw]

    def _sums(self, t: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all placements the products with the template, and sums of the masked pixels and of their squares."""
        if t.full:
            return *self._placed("even", t, "z", self.kind), self._boxes("raw", t.height, t.width), self._boxes("square", t.height, t.width)
        if self.kind is np.float64:
            total, squares = (self._placed(name, t, "on", self.kind)[0] for name in ("raw", "square"))
            cross = self._placed("even", t, "z", self.kind)[0]
        else:
            top = self._reach()
            if t.count * top <= WHOLE:
                cross, total = self._placed("even", t, "z on", np.float32)
            else:
                cross, total = self._placed("even", t, "z", np.float32)[0], self._placed("even", t, "on", np.float64)[0]
            squares = self._placed("even square", t, "on", np.float32 if t.count * top * top <= WHOLE else np.float64)[0]
        return (cross, np.rint(total), np.rint(squares)) if self.exact else (cross, total, squares)

    def _separable(self, name: str, matrices: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        v, (along, down) = self._values(name), matrices
        n, h, w = v.shape
        lines = v.reshape(n * h, w) @ along
        return np.matmul(down, lines.reshape(n, down.shape[1], -1))

    def candidates(self, t: Template, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(picture, placement) of all placements that may hold a picture's best score, where that may reach `floor`.

        The template's leading products of a column and a row are scored at all placements; the rest of it adds
        at most its part of the norm, by the inequality of Cauchy and Schwarz.  What stays below the floor, or below
        the best of the picture, with that added, is out.  None where the coarse pass wouldn't pay.
        """
        n, h, w = self.shape
        if self.kind is not np.float32 or (made := t.coarse(h, w)) is None:
            return None
        z, on, rest = made
        cross, total, squares = self._separable("even", z), self._separable("even", on), self._separable("even square", on)
        total *= total
        total *= np.float32(1 / t.count)
        spread = np.subtract(squares, total, out=total)
        squares *= np.float32(COARSE_SPREAD)
        doubtful = spread <= squares
        np.maximum(spread, np.float32(1e-3), out=spread)
        spread *= np.float32(t.norm)
        cross /= np.sqrt(spread, out=spread)
        r, doubtful = cross.reshape(n, -1), doubtful.reshape(n, -1)
        r[doubtful] = -1.0
        slack = rest + COARSE_SLACK
        low = np.fmax(floor, r.max(1) - slack) - slack
        # most pictures have no placement that reaches the floor
        live = np.flatnonzero((r.max(1) >= low) | doubtful.any(1))
        k, place = np.nonzero((r[live] >= low[live, None]) | doubtful[live])
        return live[k], place

    def at(self, t: Template, k: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Correlations of a template at single placements, -inf where one side doesn't vary."""
        nx = self.shape[2] - t.width + 1
        windows = np.lib.stride_tricks.sliding_window_view(self.region, (t.height, t.width), axis=(1, 2))
        patch = windows[k, place // nx, place % nx].reshape(len(k), -1).astype(np.float64)
        on = t.on.ravel()
        total, squares = patch @ on, np.square(patch) @ on
        spread = squares - total * total / t.count
        flat = spread <= 1e-12 * squares
        spread[flat] = 1.0
        r = ((patch - (total / t.count)[:, None]) @ t.z.ravel()) / np.sqrt(spread * t.norm)
        r[flat] = -np.inf
        return np.minimum(r, 1.0)

    def best(self, t: Template, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The best correlation of a template in each picture and the first placement that has it, in row order; -inf where
        none varies, and also where the best is below the picture's floor, if that is known without scoring all placements."""
        n, h, w = self.shape
        if h < t.height or w < t.width:
            return None
        found = self.candidates(t, floor)
        if found is None or len(found[0]) * COARSE_SHARE > n * (h - t.height + 1) * (w - t.width + 1):
            flat = self.scores(t).reshape(n, -1)
            # rounded, so that the first of equal placements is taken whatever the last bits are
            return flat.max(1).astype(np.float64), np.round(flat, 9 if flat.dtype == np.float64 else 5).argmax(1)
        k, place = found
        score, first = np.full(n, -np.inf), np.zeros(n, np.int64)
        if len(k):
            r = self.at(t, k, place)
            np.maximum.at(score, k, r)
            turn = np.lexsort((place, -np.round(r, 9), k))
            lead = turn[np.flatnonzero(np.diff(k[turn], prepend=-1))]
            first[k[lead]] = place[lead]
        return score, first

    def scores(self, t: Template) -> np.ndarray | None:
        """[n, ny, nx] correlations of a template at all placements, -inf where one side doesn't vary."""
        n, ny, nx = len(self.raw), self.raw.shape[1] - t.height + 1, self.raw.shape[2] - t.width + 1
        if ny < 1 or nx < 1:
            return None
        if t.norm <= 0:
            return np.full((n, ny, nx), -np.inf)
        cross, total, squares = self._sums(t)
        total = total.astype(np.float64)
        spread = squares - total * total / t.count
        flat = spread <= 1e-12 * squares + (0.0 if self.exact else 1e-14 * self._values("square").sum((1, 2))[:, None, None])
        spread[flat] = 1.0
        r = cross / np.sqrt(spread * t.norm)
        r[flat] = -np.inf
        return np.minimum(r, 1.0)


class Templates:
    """Collected templates with their pixels as arrays, and the rectangle that each category's regions cover."""

    def __init__(self, rows: list[Row]):
        self.rows = sorted(rows, key=lambda t: (CTYPES.index(t.ctype) if t.ctype in CTYPES else len(CTYPES), t.ctype, t.template_id))
        self.pixels = [Template(np.array(t.t, float).reshape(t.th, t.tw), np.array(t.m, bool).reshape(t.th, t.tw)) for t in self.rows]
        self.rects: dict[str, Rect] = {}
        for t in self.rows:
            x0, y0, x1, y1 = self.rects.get(t.ctype, (t.roi_x, t.roi_y, 0, 0))
            self.rects[t.ctype] = (min(x0, t.roi_x), min(y0, t.roi_y), max(x1, t.roi_x + t.roi_w), max(y1, t.roi_y + t.roi_h))
        self.ctypes = list(self.rects)

    def columns(self, frames: DataFrame, *more: Column) -> DataFrame:
        """(video_id, frame_idx, w, h, a column of pixels a category, `more`); frames whose payload isn't w x h go.

        Of frames in bands only the bands that a region meets are read, and only those are checked.
        """
        ids = [F.col("video_id").cast("long").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx")]
        size = [F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h")]
        if names := band_columns(frames):
            rows = band_rows(names)
            met = sorted({b for _, y0, _, y1 in self.rects.values() for b in range(y0 // rows, min(len(names), -(-y1 // rows)))})
            sound = frames
            for b in met:
                held = F.greatest(F.lit(0), F.least(F.lit(rows), F.col("h") - b * rows)) * F.col("w")
                sound = sound.where(F.octet_length(names[b]) == held)
            pixels = [cropped_bands(r, rows, names).alias(f"g{k}") for k, r in enumerate(self.rects.values())]
            return sound.select(*ids, *size, *pixels, *more)
        binary = isinstance(frames.schema["gray"].dataType, T.BinaryType)
        held = F.octet_length("gray") if binary else F.size("gray")
        sound = frames.where(held == F.col("w") * F.col("h"))
        # a rectangle's rows are written out for bytes; one that goes far beyond any frame is cut to the tallest
        tallest = 1 << 12
        rects = [(x0, y0, x1, min(y1, y0 + tallest)) for x0, y0, x1, y1 in self.rects.values()]
        if binary and any(r[3] - r[1] > 256 for r in rects):
            pixels = [F.col("gray").alias(f"g{k}") for k in range(len(rects))]
            self.rects = {c: (0, 0, 1 << 30, 1 << 30) for c in self.rects}
        else:
            pixels = [cropped(r if binary else rect, binary).alias(f"g{k}") for k, (r, rect) in enumerate(zip(rects, self.rects.values(), strict=True))]
        return sound.select(*ids, *size, *pixels, *more)

    def shapes(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """Frames of one size in a batch: (w, h, their places)."""
        w, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
        for size in sorted(set(zip(w.tolist(), h.tolist(), strict=True))):
            yield *size, np.flatnonzero((w == size[0]) & (h == size[1]))

    def region(self, batch: pa.RecordBatch, ctype: str, w: int, h: int, at: np.ndarray) -> np.ndarray:
        """[len(at), rows, columns] of the pixels of a category's rectangle."""
        x0, y0, x1, y1 = self.rects[ctype]
        cols, rows = max(0, min(w, x1) - x0), max(0, min(h, y1) - y0)
        column = batch.column(4 + self.ctypes.index(ctype))
        if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            # all payloads have one size, so they stand in one buffer without gaps
            picked = (column if len(at) == len(column) else column.take(pa.array(at))).cast(pa.large_binary())
            first = np.frombuffer(picked.buffers()[1], np.int64)[picked.offset]
            return np.frombuffer(picked.buffers()[2] or b"", np.uint8, len(at) * rows * cols, int(first)).reshape(len(at), rows, cols)
        picked = column if len(at) == len(column) else column.take(pa.array(at))
        return picked.flatten().to_numpy(zero_copy_only=False).reshape(len(at), rows, cols)

    def best(
        self, batch: pa.RecordBatch, ctype: str, w: int, h: int, at: np.ndarray, floor: np.ndarray | None = None
    ) -> Iterator[tuple[Row, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, best correlation or nan, x, y) for each template of a category whose region can hold it.

        With a floor for each frame, a best score below it, or below that of an earlier template, may be nan.
        """
        floor = np.full(len(at), -np.inf) if floor is None else np.array(floor, np.float64)
        x0, y0, _, _ = self.rects[ctype]
        whole = self.region(batch, ctype, w, h, at)
        size = max(1, KERNEL_PIXELS // max(1, whole.shape[1] * whole.shape[2]))
        mine = [k for k, t in enumerate(self.rows) if t.ctype == ctype]
        found: dict[int, list] = {k: [] for k in mine}
        for lo in range(0, len(at), size):
            pictures: dict[Rect, Pictures] = {}
            for k in mine:
                t = self.rows[k]
                roi = (t.roi_x - x0, t.roi_y - y0, min(t.roi_x + t.roi_w, w) - x0, min(t.roi_y + t.roi_h, h) - y0)
                if roi[2] - roi[0] < t.tw or roi[3] - roi[1] < t.th:
                    continue
                if roi not in pictures:
                    pictures[roi] = Pictures(whole[lo : lo + size, roi[1] : roi[3], roi[0] : roi[2]])
                part = floor[lo : lo + size]
                score, place = pictures[roi].best(self.pixels[k], part)
                np.fmax(part, score, out=part, where=part > -np.inf)
                nx = roi[2] - roi[0] - t.tw + 1
                found[k].append((np.where(np.isfinite(score), score, np.nan), t.roi_x + place % nx, t.roi_y + place // nx))
        for k in mine:
            if found[k]:
                yield self.rows[k], *(np.concatenate(c) for c in zip(*found[k], strict=True))


TEMPLATE_COLUMNS = ["ctype", "template_id", "roi_x", "roi_y", "roi_w", "roi_h", "tw", "th", "t", "m"]


def template_scores(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """B2: (video_id, frame_idx, ctype, template_id, score, x, y), the best placement of every template.

    frames have w, h and gray, an array of numbers or one byte a pixel.  templates have roi_x, roi_y, roi_w,
    roi_h, tw, th, t, m; the region is clamped to the frame, and one that is smaller than the template gives
    no row; neither does a frame whose payload isn't w x h.  The score is null where no placement varies.
    Only the regions' pixels leave the JVM.  Templates are the stated query set: they are counted, and
    beyond `MAX_TEMPLATES` taken in blocks, each of which is written before the next is read.
    """
    count = max(1, -(-templates.count() // MAX_TEMPLATES))
    out = None
    for k in range(count):
        rows = templates.select(*TEMPLATE_COLUMNS)
        block = Templates((rows if count == 1 else rows.where(F.pmod(F.xxhash64("ctype", "template_id"), F.lit(count)) == k)).collect())

        def run(batches: Iterator[pa.RecordBatch], block: Templates = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for w, h, at in block.shapes(batch):
                    for ctype in block.ctypes:
                        for t, score, x, y in block.best(batch, ctype, w, h, at):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(v[at], pa.int64()),
                                    pa.array(i[at], pa.int64()),
                                    pa.array([t.ctype] * len(at), pa.string()),
                                    pa.array([t.template_id] * len(at), pa.int32()),
                                    pa.array(score, pa.float64(), from_pandas=True),
                                    pa.array(x, pa.int32()),
                                    pa.array(y, pa.int32()),
                                ],
                                names=[c.split(" ")[0] for c in SCORES.split(", ")],
                            )

        part = block.columns(frames).mapInArrow(run, SCORES)
        if count > 1:
            folder = f"{work_dir(frames.sparkSession, 'scores')}/part"
            part.write.parquet(folder)
            part = frames.sparkSession.read.schema(SCORES).parquet(folder)
        out = part if out is None else out.unionByName(part)
    return out


def classify_templates(frames: DataFrame, templates: DataFrame, thr: tuple[float | Column, float | Column, float | Column, float | Column]) -> DataFrame:
    """B2-B4 in one pass without an exchange: (video_id, frame_idx, state) of frames whose payload is sound.

    The pause category goes first, only frames that it doesn't claim are scored against 1x and 2x, and only those left
    against 0.2x.  A threshold is a floor: placements whose bound is below it, or below the best so far, are not scored.
    With more than `MAX_TEMPLATES` templates B2-B4 are composed.  Thresholds are numbers, or columns of the
    frames where they differ by video.
    """
    rows = templates.select(*TEMPLATE_COLUMNS).limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        return classify_frames(frames, best_scores(template_scores(frames, templates)), thr)
    block = Templates([t for t in rows if t.ctype in CTYPES])
    limits = [value(x, "double").alias(f"_t{k}") for k, x in enumerate(thr)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = np.zeros(batch.num_rows, np.int32)
            thr = [batch.column(batch.num_columns - 4 + k).to_numpy(zero_copy_only=False) for k in range(4)]
            for w, h, at in block.shapes(batch):
                best = {c: np.full(batch.num_rows, NO_SCORE) for c in CTYPES}

                def score(ctype: str, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
                    if ctype in block.rects and len(at):
                        for _, r, _, _ in block.best(batch, ctype, w, h, at, floor):
                            best[ctype][at] = np.fmax(best[ctype][at], r)
                    return best[ctype][at]

                claimed = score("pause", at, thr[0][at]) >= thr[0][at]
                state[at[claimed]] = 1
                rest = at[~claimed]
                # a score below both thresholds decides nothing, whatever it is
                t1, t2 = thr[1][rest], thr[2][rest]
                s1, s2 = (score(c, rest, np.fmin(t1, t2)) for c in CTYPES[1:3])
                state[rest] = np.select([(s1 >= t1) & (s1 > s2), (s2 >= t2) & (s2 > s1)], [2, 3], 0)
                rest = rest[state[rest] == 0]
                state[rest[score(CTYPES[3], rest, thr[3][rest]) >= thr[3][rest]]] = 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(state)], names=["video_id", "frame_idx", "state"])

    return block.columns(frames, *limits).mapInArrow(run, "video_id long, frame_idx long, state int")


def best_scores(scores: DataFrame) -> DataFrame:
    """(video_id, frame_idx, and the best finite score of each category, -1 if it has none)."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    best = lambda c: F.max(F.when((F.col("ctype") == c) & finite, F.col("score")))
    return scores.groupBy("video_id", "frame_idx").agg(*[F.coalesce(best(c), F.lit(NO_SCORE)).alias(c) for c in CTYPES])


Thresholds = tuple[float | Column, float | Column, float | Column, float | Column]


def classify(pause: Column, s1: Column, s2: Column, s02: Column, thr: Thresholds) -> Column:
    """State by priority; a tie of 1x and 2x refuses both.  Thresholds are numbers or columns."""
    p, t1, t2, t02 = (value(x, "double") for x in thr)
    return (
        F.when(pause >= p, 1)
        .when((s1 >= t1) & (s1 > s2), 2)
        .when((s2 >= t2) & (s2 > s1), 3)
        .when(s02 >= t02, 4)
        .otherwise(0)
    )


def classify_frames(frames: DataFrame, best: DataFrame, thr: Thresholds) -> DataFrame:
    """B4 on frames: (video_id, frame_idx, state); a frame without any score is normal.  Thresholds that
    differ by video are columns of the frames."""
    limits = [value(x, "double").alias(f"_t{k}") for k, x in enumerate(thr)]
    joined = frames.select("video_id", "frame_idx", *limits).join(best, ["video_id", "frame_idx"], "left")
    score = [F.coalesce(F.col(c), F.lit(NO_SCORE)) for c in CTYPES]
    return joined.select("video_id", "frame_idx", classify(*score, tuple(F.col(f"_t{k}") for k in range(4))).alias("state"))


def locate_templates(sources: DataFrame, templates: DataFrame) -> DataFrame:
    """(ctype, template_id, x, y, score): where a template fits its category's source picture best, without a mask.

    sources (ctype, w, h, gray); ties go to the smallest y, then x.
    """
    everywhere = templates.select(
        "ctype",
        "template_id",
        F.lit(0).alias("roi_x"),
        F.lit(0).alias("roi_y"),
        F.lit(2**30).alias("roi_w"),
        F.lit(2**30).alias("roi_h"),
        "tw",
        "th",
        "t",
        F.transform("t", lambda p: F.lit(True)).alias("m"),
    )
    pictures = sources.select("ctype", "w", "h", F.col("gray").cast("array<double>").alias("gray"))
    return scored_pairs(pictures.join(prepared(everywhere), "ctype")).select("ctype", "template_id", "x", "y", "score")
