"""Numpy image kernels: tone, weather, blur, appearance, sharpness. Images are height x width x 3 in BGR order.

Parameters come from numpy's default generator with a stable seed of (name, stage, seed, condition): a plan needs no
pixels. Rain and snow go on drawing from the plan's generator when they are rendered. Rasterised streaks and discs and
border handling follow the published definitions of these filters, not any library's bits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

# Ranges of parameters, the order of tone operations, gray weights (BGR), strengths of blur.
TONE = {"brightness": (0.7, 1.3, 1.0, 0.03), "contrast": (0.7, 1.2, 1.0, 0.03), "gamma": (0.8, 1.4, 1.0, 0.03), "saturation": (0.6, 1.1, 1.0, 0.03), "noise": (0.0, 10.0, 0.0, 1.0)}
GRAY = np.array([0.114, 0.587, 0.299], np.float32)
LUMA = (1868, 9617, 4899)  # the same in 2^-14
FOG = {"t": (0.35, 0.70), "airlight": (180.0, 235.0), "airlight_jitter": (0.0, 8.0), "desat": (0.7, 1.0)}
RAIN = {"streaks_per_mpix": (366.0, 1221.0), "length_px": (10.0, 30.0), "width_px": (1.0, 2.0), "slant_deg": (70.0, 85.0), "alpha": (0.3, 0.5), "contrast": (0.8, 0.95)}
SNOW = {"density": (0.02, 0.07), "radius_px": (2.0, 6.0), "alpha": (0.5, 0.7), "brightness": (1.0, 1.15), "contrast": (0.85, 1.0), "desat": (0.8, 1.0)}
NIGHT = {"brightness": (0.35, 0.60), "gamma": (1.0, 1.4), "vignette": (0.1, 0.3)}
TINT, STREAK, FLAKE = 5.0, 200.0, 245.0
BLUR = {"fog": ("gaussian", 0.001, 0.012), "snow": ("gaussian", 0.0003, 0.008), "rain": ("motion", 0.0015, 0.030), "night": ("none", 0.0, 0.0)}
MOTION_TAPS = 17
SHORT_SIDE = 360
METRICS = ("normalized_laplacian", "laplacian_var", "hf_energy_ratio")


def seed_of(*parts) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:4], "big")


def strengths(kind: str) -> list[float]:
    """The grid of a forward curve: zero and 15 points, evenly spaced in the logarithm."""
    low, high = {"gaussian": (0.0004, 0.018), "motion": (0.0008, 0.045)}[kind]
    return [0.0, *np.round(np.geomspace(low, high, 15), 6).tolist()]


def gray(img: np.ndarray) -> np.ndarray:
    """8-bit luma of each pixel, in the fixed-point form of the usual conversion of 8-bit images."""
    b, g, r = (img[..., i].astype(np.int32) for i in range(3))
    return ((b * LUMA[0] + g * LUMA[1] + r * LUMA[2] + 8192) >> 14).astype(np.float32)


def _around_mean(x: np.ndarray, factor: float) -> np.ndarray:
    m = np.float32(x.mean(dtype=np.float64))
    return m + factor * (x - m)


def _saturate(x: np.ndarray, factor: float) -> np.ndarray:
    luma = (x @ GRAY)[..., None]
    return luma + factor * (x - luma)


def tone_plan(rng: np.random.Generator) -> dict[str, float]:
    """One to three tone operations with their parameters, none too near to no change; in the order drawn."""
    n = int(rng.integers(1, 4))
    plan = {}
    for name in rng.choice(list(TONE), size=n, replace=False).tolist():
        low, high, same, least = TONE[name]
        v = float(rng.uniform(low, high))
        if abs(v - same) < least:
            v = min(max(same + (least if v >= same else -least), low), high)
        plan[name] = v
    return plan


def tone(img: np.ndarray, plan: dict[str, float], rng: np.random.Generator) -> np.ndarray:
    """The planned operations in the table's order; clipped once at the end."""
    x = img.astype(np.float32)
    steps = {
        "brightness": lambda x, p: x * p,
        "contrast": _around_mean,
        "gamma": lambda x, p: 255.0 * (x.clip(0, 255) / 255.0) ** p,
        "saturation": _saturate,
        "noise": lambda x, p: x + rng.normal(0.0, p, x.shape).astype(np.float32) if p > 0 else x,
    }
    for name in TONE:
        if name in plan:
            x = steps[name](x, plan[name])
    return x.clip(0, 255)


def weather_plan(rng: np.random.Generator, condition: str, height: int, width: int) -> dict[str, float]:
    """Parameters of a condition; a warm tint of the night is 1, a cool one -1."""
    u = lambda r: float(rng.uniform(*r))
    if condition == "fog":
        t, base, jitter = u(FOG["t"]), u(FOG["airlight"]), u(FOG["airlight_jitter"])
        b, g, r = (base + rng.uniform(-jitter, jitter, size=3)).clip(0, 255).tolist()
        return {"t": t, "air_b": b, "air_g": g, "air_r": r, "desat": u(FOG["desat"])}
    if condition == "rain":
        first, *rest = RAIN
        n = max(1, round(u(RAIN[first]) * height * width / 1e6))
        return {"n_streaks": float(n)} | {k: u(RAIN[k]) for k in rest}
    if condition == "snow":
        density, (low, high) = u(SNOW["density"]), SNOW["radius_px"]
        n = max(1, round(density * height * width / (np.pi * ((low + high) / 2) ** 2)))
        return {"n_particles": float(n), "density": density, "radius_low": low, "radius_high": high} | {k: u(SNOW[k]) for k in ("alpha", "brightness", "contrast", "desat")}
    if condition == "night":
        brightness, gamma = u(NIGHT["brightness"]), u(NIGHT["gamma"])
        warm = rng.choice(("warm", "cool")) == "warm"
        return {"brightness": brightness, "gamma": gamma, "tint": 1.0 if warm else -1.0, "vignette": u(NIGHT["vignette"])}
    raise ValueError(f"unknown condition: {condition}")


def _soften(mask: np.ndarray) -> np.ndarray:
    """A 3 x 3 binomial filter with mirrored borders."""
    for axis in (0, 1):
        if mask.shape[axis] > 1:
            p = np.pad(mask, [(1, 1) if a == axis else (0, 0) for a in range(mask.ndim)], "reflect")
            n = mask.shape[axis]
            mask = 0.25 * np.take(p, range(n), axis) + 0.5 * np.take(p, range(1, n + 1), axis) + 0.25 * np.take(p, range(2, n + 2), axis)
    return mask


def _disc(cover: np.ndarray, cx: int, cy: int, r: int) -> None:
    """Sets the pixels of a disc to 1, as far as it lies inside."""
    y0, y1, x0, x1 = max(0, cy - r), min(cover.shape[0], cy + r + 1), max(0, cx - r), min(cover.shape[1], cx + r + 1)
    if y0 < y1 and x0 < x1:
        dy, dx = np.arange(y0, y1)[:, None] - cy, np.arange(x0, x1)[None, :] - cx
        cover[y0:y1, x0:x1][dy * dy + dx * dx <= r * r] = 1.0


def weather(img: np.ndarray, condition: str, p: dict[str, float], rng: np.random.Generator) -> np.ndarray:
    x = img.astype(np.float32)
    h, w = x.shape[:2]
    if condition == "fog":
        air = np.array([p["air_b"], p["air_g"], p["air_r"]], np.float32)
        x = _saturate(air + p["t"] * (x - air), p["desat"])
    elif condition == "rain":
        cover = np.zeros((h, w), np.float32)
        run, rise = np.cos(np.radians(p["slant_deg"])) * p["length_px"], np.sin(np.radians(p["slant_deg"])) * p["length_px"]
        steps = np.linspace(0.0, 1.0, 2 + int(p["length_px"]))
        for _ in range(int(p["n_streaks"])):
            x0, y0 = rng.uniform(0.0, w), rng.uniform(0.0, h)
            side = 1.0 if rng.random() < 0.5 else -1.0
            for k in range(max(1, round(p["width_px"]))):
                cols, rows = np.rint(x0 + side * run * steps).astype(int) + k, np.rint(y0 - rise * steps).astype(int)
                ok = (cols >= 0) & (cols < w) & (rows >= 0) & (rows < h)
                cover[rows[ok], cols[ok]] = STREAK
        x = _around_mean(x + p["alpha"] * _soften(cover)[..., None], p["contrast"])
    elif condition == "snow":
        cover = np.zeros((h, w), np.float32)
        for _ in range(int(p["n_particles"])):
            cx, cy = int(rng.integers(0, w + 1)), int(rng.integers(0, h + 1))
            _disc(cover, cx, cy, round(rng.uniform(p["radius_low"], p["radius_high"])))
        a = p["alpha"] * _soften(cover)[..., None]
        x = _saturate(_around_mean((x * (1 - a) + FLAKE * a) * p["brightness"], p["contrast"]), p["desat"])
    elif condition == "night":
        x = 255.0 * ((x * p["brightness"]).clip(0, 255) / 255.0) ** p["gamma"]
        x = (x + p["tint"] * TINT * np.array([-1.0, 0.0, 1.0], np.float32)).clip(0, 255)
        bell = lambda n: np.exp(-((np.arange(n) - (n - 1) / 2) ** 2) / (2 * (n * 0.5) ** 2))
        mask = np.outer(bell(h), bell(w)).astype(np.float32)
        x = x * (1 - p["vignette"] * (1 - mask / mask.max()))[..., None]
    return x.clip(0, 255)


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Indices reflected at the borders, the border pixel not repeated."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def _axis_product(img: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ img @ right.T for each channel: a separable linear filter with its borders in the matrices."""
    flat = img.astype(np.float32).reshape(img.shape[0], -1)
    out = (left @ flat).reshape(left.shape[0], *img.shape[1:])
    return np.moveaxis(np.tensordot(right, out, (1, 1)), 0, 1)


@lru_cache(64)
def _gaussian_matrix(n: int, sigma: float) -> np.ndarray:
    """The Gaussian's weights for each of n pixels on a line, mirrored at both ends."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), 2 * r + 1), _mirror(np.arange(n)[:, None] + np.arange(-r, r + 1), n).ravel()), np.tile(k / k.sum(), n))
    return out.astype(np.float32)


def defocus(img: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return img
    return _axis_product(img, *(_gaussian_matrix(n, sigma) for n in img.shape[:2]))


def motion(img: np.ndarray, length: float, angle: float) -> np.ndarray:
    """The mean of 17 copies, shifted by fractions of a pixel along the direction, linearly interpolated.

    Each copy is a weighted sum of four whole shifts: the weights of equal shifts of all copies are added first.
    """
    if length <= 0:
        return img
    weights: dict[tuple[int, int], float] = {}
    for d in np.linspace(-0.5, 0.5, MOTION_TAPS) * length:
        x, y = -np.cos(np.radians(angle)) * d, np.sin(np.radians(angle)) * d
        x0, y0 = int(np.floor(x)), int(np.floor(y))
        for dx, wx in ((x0, 1 - (x - x0)), (x0 + 1, x - x0)):
            for dy, wy in ((y0, 1 - (y - y0)), (y0 + 1, y - y0)):
                if wx * wy > 0:
                    weights[dx, dy] = weights.get((dx, dy), 0.0) + wx * wy / MOTION_TAPS
    h, w = img.shape[:2]
    rx, ry = (max(abs(k[i]) for k in weights) for i in (0, 1))
    wide = img.astype(np.float32)[_mirror(np.arange(-ry, h + ry), h)][:, _mirror(np.arange(-rx, w + rx), w)]
    out = np.zeros(img.shape, np.float32)
    for (dx, dy), weight in weights.items():
        out += np.float32(weight) * wide[ry + dy : ry + dy + h, rx + dx : rx + dx + w]
    return out


def blur(img: np.ndarray, kind: str, frac: float, angle: float = 77.5) -> np.ndarray:
    """Blur with a strength that is a share of the short side."""
    size = frac * min(img.shape[:2])
    return defocus(img, size) if kind == "gaussian" else motion(img, size, angle) if kind == "motion" else img


def appearance_many(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Of each image of a stack (n x height x width x 3): mean and population std of each channel, mean 8-bit HSV saturation
    (fixed point), mean luma."""
    top, low = stack.max(3).astype(np.int64), stack.min(3).astype(np.int64)
    sat = ((top - low) * np.rint(1044480 / np.maximum(top, 1)).astype(np.int64) + 2048) >> 12
    x = stack.astype(np.float64)
    out = {f"mean_{c}": x[..., i].mean((1, 2)) for i, c in enumerate("bgr")} | {f"std_{c}": x[..., i].std((1, 2)) for i, c in enumerate("bgr")}
    return out | {"saturation": sat.mean((1, 2)), "luma": gray(stack).mean((1, 2), dtype=np.float64)}


def appearance(img: np.ndarray) -> dict[str, float]:
    return {k: float(v[0]) for k, v in appearance_many(img[None]).items()}


def match(img: np.ndarray, target: dict[str, float]) -> np.ndarray:
    """Each channel shifted and scaled to the target's mean and std."""
    x = img.astype(np.float32).clip(0, 255)
    mean = np.array([target[f"mean_{c}"] for c in "bgr"])
    std = np.array([target[f"std_{c}"] for c in "bgr"])
    own = x.std((0, 1), dtype=np.float64).clip(1e-3)
    scale = std / own
    return (x * scale.astype(np.float32) + (mean - x.mean((0, 1), dtype=np.float64) * scale).astype(np.float32)).clip(0, 255)


def draw(q: list[float], rng: np.random.Generator, low: float = 0.0, high: float = 255.0) -> float:
    """A value of the distribution that the evenly spaced quantiles describe, cut to [low, high]; the middle without any."""
    if not len(q):
        return 0.5 * (low + high)
    return float(min(max(np.interp(rng.random() * (len(q) - 1), np.arange(len(q)), q), low), high))


@lru_cache(64)
def _area_matrix(n: int, m: int) -> np.ndarray:
    """Weights by which n pixels on a line become m: means over areas; between two neighbours where pixels are added."""
    out = np.zeros((m, n))
    step = n / m
    if step >= 1:
        edges = np.arange(m + 1) * step
        for i in range(m):
            first, last = int(edges[i]), min(n - 1, int(np.ceil(edges[i + 1])) - 1)
            at = np.arange(first, last + 1)
            out[i, at] = np.minimum(at + 1, edges[i + 1]) - np.maximum(at, edges[i])
        return (out / out.sum(1, keepdims=True)).astype(np.float32)
    at = np.arange(m)
    first = np.floor(at * step).astype(int)
    part = (at + 1) - (first + 1) / step
    part = np.where(part <= 0, 0.0, part - np.floor(part))
    np.add.at(out, (at, first), 1 - part)
    np.add.at(out, (at, np.minimum(first + 1, n - 1)), part)
    return out.astype(np.float32)


def measured(gray: np.ndarray, short: int = SHORT_SIDE) -> np.ndarray:
    """The image resized so that its short side is `short`, by areas."""
    h, w = gray.shape
    scale = short / min(h, w)
    if abs(scale - 1) <= 1e-3:
        return gray
    return _axis_product(gray, *(_area_matrix(n, max(1, round(n * scale))) for n in (h, w)))


@lru_cache(8)
def _spectrum(h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window, the weight of each coefficient of a real transform, and the same for frequencies of 0.25 and more."""
    radius = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w)[None, :])
    weight = np.full(radius.shape, 2.0, np.float32)  # a real image's other half is the same
    weight[:, 0] = 1.0
    if w % 2 == 0:
        weight[:, -1] = 1.0
    return np.outer(np.hanning(h), np.hanning(w)).astype(np.float32), weight, weight * (radius >= 0.25)


def sharpness(gray: np.ndarray) -> dict[str, float]:
    """Laplacian variance, the same over the variance, and the share of windowed energy at frequencies of 0.25 and more."""
    g = measured(gray.astype(np.float32))
    wide = np.pad(g, 1, "reflect") if min(g.shape) > 1 else np.pad(g, 1, "edge")
    lap = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * g
    window, weight, high = _spectrum(*g.shape)
    found = np.fft.rfft2((g - g.mean(dtype=np.float64).astype(np.float32)) * window)
    power = found.real**2 + found.imag**2
    total = float((power * weight).sum(dtype=np.float64))
    spread, edges = float(g.var(dtype=np.float64)), float(lap.var(dtype=np.float64))
    return {"normalized_laplacian": edges / (spread + 1e-6), "laplacian_var": edges, "hf_energy_ratio": float((power * high).sum(dtype=np.float64)) / max(total, 1e-9)}


#: Pixels of an image up to which sharpness_many measures it by its own pixels, without and with the spectrum: an image of
#: more is enlarged less, and resizing it costs less than sums over pairs of its pixels.
FORM_PIXELS, SPECTRUM_PIXELS = 4_096, 1_024


@lru_cache(64)
def _line(n: int, m: int) -> tuple[np.ndarray, ...]:
    """Sums over a line of n pixels resized to m: products of the resized line with itself (p), of its second differences
    (q), of these with the line (r), of the line under a Hann window (win); sums of the line and of its second differences."""
    a = _area_matrix(n, m).astype(np.float64)
    wide = np.pad(a, [(1, 1), (0, 0)], "reflect")
    d = wide[:-2] + wide[2:] - 2 * a
    windowed = np.hanning(m)[:, None] * a
    return a.T @ a, d.T @ d, d.T @ a, windowed.T @ windowed, a.sum(0), d.sum(0)


@lru_cache(8)
def _high_form(h: int, w: int, high: int, wide: int) -> np.ndarray:
    """The matrix M by which x M x is the windowed energy at frequencies of 0.25 and more of x resized to high x wide."""
    weight = _spectrum(high, wide)[2].astype(np.float64)
    u = np.fft.fft(np.hanning(high)[:, None] * _area_matrix(h, high), axis=0)
    v = np.fft.rfft(np.hanning(wide)[:, None] * _area_matrix(w, wide), axis=0)
    pairs = lambda x: (x.conj()[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    out = (pairs(u).T @ (weight @ pairs(v))).real
    return np.ascontiguousarray(out.reshape(h, h, w, w).transpose(0, 2, 1, 3).reshape(h * w, h * w))


def sharpness_many(grays: np.ndarray, names: tuple[str, ...] = METRICS) -> dict[str, np.ndarray]:
    """`sharpness` of each image of a stack (n x height x width), those of `names`.

    Resizing, differences and the spectrum are linear, so that for a small image the sums of their squares are quadratic
    forms of its own pixels: no image is enlarged to the measured size. Larger ones are measured one by one.
    """
    h, w = grays.shape[1:]
    spectrum = "hf_energy_ratio" in names
    if h * w > (SPECTRUM_PIXELS if spectrum else FORM_PIXELS) or min(h, w) >= SHORT_SIDE:
        each = [sharpness(g) for g in grays]
        return {n: np.array([e[n] for e in each]) for n in names}
    high, wide = (max(1, round(n * SHORT_SIDE / min(h, w))) for n in (h, w))
    (p1, q1, r1, win1, a1, d1), (p2, q2, r2, win2, a2, d2) = _line(h, high), _line(w, wide)
    area = high * wide
    x = grays.astype(np.float64)
    x = x - ((a1 @ x) @ a2 / area)[:, None, None]
    n = 4 if spectrum else 3
    left, right = np.concatenate([p1, q1, r1.T, win1][:n]) @ x, x @ np.concatenate([p2, q2, r2, win2][:n], 1)
    form = lambda i, j: np.einsum("nij,nij->n", left[:, i * h : i * h + h], right[:, :, j * w : j * w + w])
    spread = form(0, 0) / area
    edges = (form(1, 0) + form(0, 1) + 2 * form(2, 2)) / area - (((d1 @ x) @ a2 + (a1 @ x) @ d2) / area) ** 2
    edges = edges.clip(0)
    out = {"normalized_laplacian": edges / (spread + 1e-6), "laplacian_var": edges}
    if spectrum:
        flat = x.reshape(len(x), h * w)
        energy = np.einsum("ni,ni->n", flat @ _high_form(h, w, high, wide), flat).clip(0)
        out["hf_energy_ratio"] = energy / np.maximum(area * form(3, 3), 1e-9)
    return {n: out[n] for n in names}


def blur_many(grays: np.ndarray, kind: str, frac: float) -> np.ndarray:
    """`blur` of each gray image of a stack (n x height x width), as channels of one image."""
    return np.moveaxis(blur(np.moveaxis(grays, 0, -1), kind, frac), -1, 0)


def box_std(gray: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> list[float]:
    """Population std of the gray pixels in each box (x0, y0, x1, y1)."""
    return [float(gray[y0:y1, x0:x1].std(dtype=np.float64)) if x1 > x0 and y1 > y0 else 0.0 for x0, y0, x1, y1 in boxes]


def usable(img: np.ndarray, least_mean: float = 5.0) -> bool:
    return least_mean <= img.mean() <= 250 and img.std() >= 10
