"""Filter design in NumPy: analog prototypes, bilinear transform, second-order sections, tapers."""

from __future__ import annotations

import numpy as np

Zpk = tuple[np.ndarray, np.ndarray, float]


def buttap(n: int) -> Zpk:
    p = -np.exp(1j * np.pi * np.arange(-n + 1, n, 2) / (2 * n))
    return np.zeros(0), p, 1.0


def cheb1ap(n: int, ripple: float) -> Zpk:
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    mu, theta = np.arcsinh(1 / eps) / n, np.pi * np.arange(-n + 1, n, 2) / (2 * n)
    p = -np.sinh(mu + 1j * theta)
    k = float(np.prod(-p).real)
    return np.zeros(0), p, k / np.sqrt(1 + eps * eps) if n % 2 == 0 else k


def cheb2ap(n: int, stop: float) -> Zpk:
    mu = np.arcsinh(np.sqrt(10 ** (stop / 10) - 1)) / n
    m = np.arange(-n + 1, n, 2)
    z = 1j / np.sin(m[m != 0] * np.pi / (2 * n))
    p = -np.exp(1j * np.pi * m / (2 * n))
    p = 1 / (np.sinh(mu) * p.real + 1j * np.cosh(mu) * p.imag)
    return z, p, float((np.prod(-p) / np.prod(-z)).real)


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-15 and len(out) < 12:
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _cde(u, k: float):
    """cd of u quarter periods, by descending Landen steps."""
    w = np.cos(np.asarray(u) * np.pi / 2)
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _sne(u, k: float):
    w = np.sin(np.asarray(u) * np.pi / 2)
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _asne(w: complex, k: float) -> complex:
    before = k
    for v in _landen(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (before * w) ** 2 + 0j)))
        before = v
    return 2 / np.pi * np.arcsin(w + 0j)


def ellipap(n: int, ripple: float, stop: float) -> Zpk:
    """Elliptic prototype through the degree equation."""
    ep, es = np.sqrt(10 ** (ripple / 10) - 1), np.sqrt(10 ** (stop / 10) - 1)
    k1 = ep / es
    kc = np.sqrt(1 - k1 * k1)
    half = n // 2
    u = (2 * np.arange(1, half + 1) - 1) / n
    k = np.sqrt(1 - (kc**n * np.prod(_sne(u, kc)) ** 4) ** 2)
    zeta = _cde(u, k)
    z = np.concatenate((1j / (k * zeta), -1j / (k * zeta)))
    v0 = -1j * _asne(1j / ep, k1) / n
    p = 1j * _cde(u - 1j * v0, k)
    p = np.concatenate((p, p.conj()))
    if n % 2:
        p = np.append(p, 1j * _sne(1j * v0, k))
    gain = float((np.prod(-p) / np.prod(-z)).real)
    return z, p, gain if n % 2 else gain / np.sqrt(1 + ep * ep)


def _to_low(z, p, k, w):
    return z * w, p * w, k * w ** (len(p) - len(z))


def _to_high(z, p, k, w):
    gain = k * float((np.prod(-z) / np.prod(-p)).real)
    return np.concatenate((w / z, np.zeros(len(p) - len(z)))), w / p, gain


def _to_band(z, p, k, w0, bw):
    def both(x):
        x = x * bw / 2
        root = np.sqrt(x.astype(complex) ** 2 - w0**2)
        return np.concatenate((x + root, x - root))

    return np.concatenate((both(z), np.zeros(len(p) - len(z)))), both(p), k * bw ** (len(p) - len(z))


def _bilinear(z, p, k, fs=2.0):
    f = 2 * fs
    gain = k * float((np.prod(f - z) / np.prod(f - p)).real)
    return np.concatenate(((f + z) / (f - z), -np.ones(len(p) - len(z)))), (f + p) / (f - p), gain


def to_sos(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2); poles nearest the circle last, each with the zeros nearest to it."""

    def pairs(r):
        r = np.asarray(r, complex)
        up = sorted(r[r.imag > 1e-10], key=lambda x: (abs(1 - abs(x)), x.real))
        real = sorted(r[np.abs(r.imag) <= 1e-10].real, key=abs)
        out = [(x, x.conjugate()) for x in up]
        while len(real) > 1:
            out.append((real.pop(), real.pop(0) if len(real) > 1 else real.pop()))
        return out + [(x, 0.0) for x in real]

    zs, ps = pairs(z), pairs(p)
    zs += [(0.0, 0.0)] * (len(ps) - len(zs))
    sections = []
    for a, b in sorted(ps, key=lambda q: -abs(q[0])):
        at = min(range(len(zs)), key=lambda i: abs(zs[i][0] - a))
        c, d = zs.pop(at)
        sections.append([1.0, -(c + d).real if isinstance(c + d, complex) else -(c + d), (c * d).real if isinstance(c * d, complex) else c * d, 1.0, -np.real(a + b), np.real(a * b)])
    sos = np.array(sections[::-1], float)
    sos[0, :3] *= k
    return sos


def _bands(lo: float | None, hi: float | None, fs: float) -> tuple[str, np.ndarray]:
    """Values that are None or not positive are unset: low only is a high-pass, high only a low-pass."""
    w = [2 * x / fs for x in (lo, hi) if x is not None and x > 0]
    if any(x >= 1 for x in w) or not w:
        raise ValueError("cut-offs lie between nought and half the sampling rate")
    kind = "band" if len(w) == 2 else "high" if lo is not None and lo > 0 else "low"
    return kind, 4 * np.tan(np.pi * np.array(w) / 2)


def _design(proto: Zpk, lo: float | None, hi: float | None, fs: float) -> np.ndarray:
    kind, w = _bands(lo, hi, fs)
    if kind == "low":
        zpk = _to_low(*proto, w[0])
    elif kind == "high":
        zpk = _to_high(*proto, w[0])
    else:
        zpk = _to_band(*proto, np.sqrt(w[0] * w[1]), w[1] - w[0])
    return to_sos(*_bilinear(*zpk))


def butter(lo=None, hi=None, fs: float = 2.0, order: int = 3) -> np.ndarray:
    return _design(buttap(order), lo, hi, fs)


def cheby1(ripple: float, lo=None, hi=None, fs: float = 2.0, order: int = 3) -> np.ndarray:
    return _design(cheb1ap(order, ripple), lo, hi, fs)


def cheby2(stop: float, lo=None, hi=None, fs: float = 2.0, order: int = 3) -> np.ndarray:
    return _design(cheb2ap(order, stop), lo, hi, fs)


def ellip(stop: float, ripple: float, lo=None, hi=None, fs: float = 2.0, order: int = 4) -> np.ndarray:
    return _design(ellipap(order, ripple, stop), lo, hi, fs)


def cheb1_order(pass_edge: float, stop_edge: float, ripple: float, stop: float) -> int:
    """Least order of a low-pass with these edges (in Nyquist units) and losses (dB)."""
    w = np.tan(np.pi * stop_edge / 2) / np.tan(np.pi * pass_edge / 2)
    return int(np.ceil(np.arccosh(np.sqrt((10 ** (stop / 10) - 1) / (10 ** (ripple / 10) - 1))) / np.arccosh(w)))


def notch(fcut: float, fs: float = 2.0, width: float = 3.0, poles: int = 3, zeros: int = 3) -> np.ndarray:
    """Zeros on the circle at a line's angle, poles behind them at 1 - width * 2 / fs; the gain is left as it is."""
    angle, radius, out = 2 * np.pi * fcut / fs, 1 - width * 2 / fs, []
    for k in range(max(poles, zeros)):
        b = [1.0, -2 * np.cos(angle), 1.0] if k < zeros else [1.0, 0.0, 0.0]
        a = [1.0, -2 * radius * np.cos(angle), radius**2] if k < poles else [1.0, 0.0, 0.0]
        out.append([*b, *a])
    return np.array(out)


def design(kind: str, **args) -> np.ndarray:
    """By name: butter, cheby1, cheby2, ellip or notch."""
    makers = {"butter": butter, "butterworth": butter, "cheby1": cheby1, "cheby2": cheby2, "ellip": ellip, "notch": notch}
    if kind not in makers:
        raise ValueError(f"no filter of kind {kind!r}")
    return makers[kind](**args)


def response(sos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Complex response at angular frequencies (radians a sample)."""
    z = np.exp(-1j * np.asarray(w))
    out = np.ones(len(z), complex)
    for b0, b1, b2, _, a1, a2 in sos:
        out *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return out


def linear_phase_amplitude(ft: np.ndarray) -> np.ndarray:
    """The real amplitude of a linear-phase response, with the sign changes that |.| hides."""
    mag, out, sign = np.abs(ft), [], 1.0
    slope = np.angle(ft[1:] * np.conj(ft[:-1]))
    usual = np.median(slope)
    for k, m in enumerate(mag):
        if k and abs(np.angle(np.exp(1j * (slope[k - 1] - usual)))) > np.pi / 2:
            sign = -sign
        out.append(sign * m)
    return np.array(out)


def tapers(n: int, nw: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Discrete prolate tapers (k x n) and their concentrations, from the commuting tridiagonal matrix."""
    t = np.arange(n)
    w = nw / n
    diagonal = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = t[1:] * (n - t[1:]) / 2
    _, v = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    v = v[:, ::-1][:, :k].T
    for i, row in enumerate(v):
        if (i % 2 == 0 and row.sum() < 0) or (i % 2 and row[: max(1, n // 2)].sum() < 0):
            v[i] = -row
    lag = 2 * w * np.sinc(2 * w * t)
    size = 1 << (2 * n - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(v, size, axis=1)) ** 2, size, axis=1)[:, :n]
    return v, 2 * (auto * lag).sum(axis=1) - auto[:, 0] * lag[0]


def moving_projection_taps(n: int, bw: float, fs: float = 1.0, window: np.ndarray | None = None) -> np.ndarray:
    """Sliding projection on n-sample tapers, weighted by concentration and averaged over overlaps, is one filter of
    2n - 1 taps."""
    nw = n * bw / fs
    k = max(1, int(round(2 * nw)) - 1)
    v, lam = tapers(n, nw, k)
    w = np.ones(n) / n if window is None else window / window.sum()
    g = np.zeros(2 * n - 1)
    for d in range(-(n - 1), n):
        i = np.arange(max(0, -d), min(n, n - d))
        g[d + n - 1] = sum(lam[j] * (w[i] * v[j, i] * v[j, i + d]).sum() for j in range(k))
    return g


def rc_section(r: float, c: float, series: float, fs: float, prewarp: float | None = None, inverse: bool = False) -> np.ndarray:
    """An electrode (resistor and capacitor side by side, a resistor before) as a first-order section between voltage
    and current; ``inverse``: current to voltage."""
    # impedance Z(s) = series + r / (1 + r c s)
    num, den = np.array([series * r * c, series + r]), np.array([r * c, 1.0])
    if not inverse:
        num, den = den, num
    f = 2 * fs if prewarp is None else 2 * np.pi * prewarp / np.tan(np.pi * prewarp / fs)
    b, a = np.array([num[0] * f + num[1], num[1] - num[0] * f]), np.array([den[0] * f + den[1], den[1] - den[0] * f])
    return np.array([[b[0] / a[0], b[1] / a[0], 0.0, 1.0, a[1] / a[0], 0.0]])


def circuit(b: tuple[float, float], a: tuple[float, float]) -> tuple[float, float, float]:
    """(r, c, series) of the impedance (b0 s + b1) / (a0 s + a1)."""
    series = b[0] / a[0]
    r = b[1] / a[1] - series
    return r, a[0] / a[1] / r, series
