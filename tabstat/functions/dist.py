"""Normal distribution as Column expressions, plus driver-side tails.

Spark SQL and DuckDB have no ``erf``; the standard normal cdf is written as
a rational approximation accurate to double precision (Hart 1968, as
published by West 2005), and the quantile as Acklam's rational
approximation refined by one Halley step. Each formula is built once from
a small expression algebra and rendered either as a Spark ``Column`` or as
SQL text, so the oracle evaluates the very same arithmetic.

Driver-side scalar functions (regularized incomplete beta and gamma,
Student t, F, chi-square, Kolmogorov) are plain Python on a handful of
numbers: the statistics they turn into p-values were reduced on Spark.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published approximations.
# Hart (1968) double-precision normal cdf, numerator then denominator.
HART_NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_SPLIT = 7.07106781186547
HART_CUTOFF = 37.0
# Acklam's normal quantile: central (A/B) and tail (C/D) polynomials.
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00]
ACKLAM_PLOW = 0.02425
SQRT_2PI = 2.5066282746310002


# --- a tiny expression algebra rendered to Spark Columns or SQL text -------

class _E:
    """Arithmetic expression that renders to a Column or to SQL.

    The Column side is built lazily (and memoised), so SQL text can be
    rendered without a running Spark session.
    """

    def __init__(self, col, sql):
        self._colf = col if callable(col) and not isinstance(col, Column) else (lambda c=col: c)
        self._col = None
        self.sql = sql

    @property
    def col(self) -> Column:
        if self._col is None:
            self._col = self._colf()
        return self._col

    @staticmethod
    def wrap(x):
        if isinstance(x, _E):
            return x
        v = float(x)
        return _E(lambda: F.lit(v), f"CAST({repr(v)} AS DOUBLE)")

    def _bin(self, other, op):
        import operator
        o = _E.wrap(other)
        fn = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}[op]
        return _E(lambda: fn(self.col, o.col), f"({self.sql} {op} {o.sql})")

    def __add__(self, o):
        return self._bin(o, "+")

    def __radd__(self, o):
        return _E.wrap(o)._bin(self, "+")

    def __sub__(self, o):
        return self._bin(o, "-")

    def __rsub__(self, o):
        return _E.wrap(o)._bin(self, "-")

    def __mul__(self, o):
        return self._bin(o, "*")

    def __rmul__(self, o):
        return _E.wrap(o)._bin(self, "*")

    def __truediv__(self, o):
        return self._bin(o, "/")

    def __rtruediv__(self, o):
        return _E.wrap(o)._bin(self, "/")

    def __neg__(self):
        return _E(lambda: -self.col, f"(-{self.sql})")


def sql_leaf(sql: str) -> _E:
    """A named input for SQL-only rendering."""
    return _E(lambda: F.col(sql), sql)


def _fn(name, x: _E) -> _E:
    def build():
        spark_fn = {"exp": F.exp, "abs": F.abs, "ln": F.log, "sqrt": F.sqrt, "sign": F.signum}[name]
        return spark_fn(x.col)
    return _E(build, f"{name}({x.sql})")


def _pow(x: _E, y) -> _E:
    y = _E.wrap(y)
    return _E(lambda: F.pow(x.col, y.col), f"pow({x.sql}, {y.sql})")


def _when(cond, cond_sql, a: _E, b: _E) -> _E:
    a, b = _E.wrap(a), _E.wrap(b)
    return _E(lambda: F.when(cond(), a.col).otherwise(b.col),
              f"(CASE WHEN {cond_sql} THEN {a.sql} ELSE {b.sql} END)")


def _poly(coefs, x: _E) -> _E:
    acc = _E.wrap(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def _cmp(a: _E, op: str, b) -> tuple:
    import operator
    b = _E.wrap(b)
    fn = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    return (lambda: fn(a.col, b.col)), f"({a.sql} {op} {b.sql})"


def _norm_cdf_e(x: _E) -> _E:
    ax = _fn("abs", x)
    e = _fn("exp", -(ax * ax) / 2.0)
    rational = e * _poly(HART_NUM, ax) / _poly(HART_DEN, ax)
    cf = ax + 0.65
    cf = ax + 4.0 / cf
    cf = ax + 3.0 / cf
    cf = ax + 2.0 / cf
    cf = ax + 1.0 / cf
    tail = e / cf / SQRT_2PI
    lower = _when(*_cmp(ax, "<", HART_SPLIT), rational, tail)
    lower = _when(*_cmp(ax, ">", HART_CUTOFF), _E.wrap(0.0), lower)
    return _when(*_cmp(x, ">", 0.0), 1.0 - lower, lower)


def _norm_ppf_e(p: _E) -> _E:
    """Acklam's rational approximation (relative error < 1.2e-9)."""
    q = p - 0.5
    r = q * q
    central = _poly(ACKLAM_A, r) * q / (_poly(ACKLAM_B, r) * r + 1.0)
    ql = _fn("sqrt", -2.0 * _fn("ln", p))
    low = _poly(ACKLAM_C, ql) / (_poly(ACKLAM_D, ql) * ql + 1.0)
    qh = _fn("sqrt", -2.0 * _fn("ln", 1.0 - p))
    high = -(_poly(ACKLAM_C, qh) / (_poly(ACKLAM_D, qh) * qh + 1.0))
    return _when(*_cmp(p, "<", ACKLAM_PLOW), low,
                 _when(*_cmp(p, ">", 1.0 - ACKLAM_PLOW), high, central))


def _halley_e(x: _E, p: _E) -> _E:
    """One Halley step of x towards Φ⁻¹(p); x must be a plain column."""
    err = _norm_cdf_e(x) - p
    u = err * SQRT_2PI * _fn("exp", x * x / 2.0)
    return x - u / (1.0 + x * u / 2.0)


def norm_cdf(col: Column | str) -> Column:
    """Standard normal cdf Φ(x) as a native Column expression."""
    c = F.col(col) if isinstance(col, str) else col
    return _norm_cdf_e(_E(c.cast("double"), "x")).col


def norm_ppf(col: Column | str) -> Column:
    """Standard normal quantile Φ⁻¹(p) (Acklam, relative error < 1.2e-9).

    p in (0, 1); 0 and 1 give ∓inf. For full double precision use
    :func:`with_norm_ppf` (one Halley step on a staged column).
    """
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    body = _norm_ppf_e(_E(c, "p")).col
    return (F.when(c <= 0.0, F.lit(float("-inf")))
            .when(c >= 1.0, F.lit(float("inf")))
            .otherwise(body))


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    """Φ(x) of many numbers at once, by the arithmetic of :func:`norm_cdf`."""
    ax = np.abs(x)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        e = np.exp(-(ax * ax) / 2.0)
        lower = e * _hp(HART_NUM, ax) / _hp(HART_DEN, ax)
        far = ax >= HART_SPLIT
        cf = ax[far] + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            cf = ax[far] + k / cf
        lower[far] = e[far] / cf / SQRT_2PI
        lower[ax > HART_CUTOFF] = 0.0
    return np.where(x > 0.0, 1.0 - lower, lower)


def norm_ppf_array(p: np.ndarray) -> np.ndarray:
    """Φ⁻¹(p) of many numbers at once, by the arithmetic of :func:`norm_ppf`."""
    q = p - 0.5
    r = q * q
    out = _hp(ACKLAM_A, r) * q / (_hp(ACKLAM_B, r) * r + 1.0)
    low, high = p < ACKLAM_PLOW, p > 1.0 - ACKLAM_PLOW
    with np.errstate(divide="ignore", invalid="ignore"):
        ql, qh = np.sqrt(-2.0 * np.log(p[low])), np.sqrt(-2.0 * np.log(1.0 - p[high]))
        out[low] = _hp(ACKLAM_C, ql) / (_hp(ACKLAM_D, ql) * ql + 1.0)
        out[high] = -(_hp(ACKLAM_C, qh) / (_hp(ACKLAM_D, qh) * qh + 1.0))
    out[p <= 0.0], out[p >= 1.0] = -np.inf, np.inf
    return out


def with_norm_ppf(df, p_col: str, out: str):
    """Add ``out`` = Φ⁻¹(p) refined to double precision.

    The first approximation is projected as its own column so the Halley
    step references it instead of duplicating its expression tree.
    """
    staged = df.withColumn(out, norm_ppf(p_col))
    x = _E(F.col(out), out)
    p = _E(F.col(p_col).cast("double"), p_col)
    refined = _halley_e(x, p).col
    return staged.withColumn(out, F.when(F.abs(F.col(out)) < 1e300, refined).otherwise(F.col(out)))


def norm_cdf_sql(expr_sql: str) -> str:
    """Same Φ as SQL text (for the DuckDB oracle)."""
    return _norm_cdf_e(sql_leaf(f"CAST({expr_sql} AS DOUBLE)")).sql


def norm_ppf_sql(expr_sql: str) -> str:
    """Same Φ⁻¹ as SQL text (valid for 0 < p < 1)."""
    return _norm_ppf_e(sql_leaf(f"CAST({expr_sql} AS DOUBLE)")).sql


# --- driver-side scalar functions ------------------------------------------

def phi(x: float) -> float:
    """Standard normal cdf (driver scalar)."""
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def phi_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def phi_inv(p: float) -> float:
    """Standard normal quantile (driver scalar), Acklam + Halley step."""
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    if p < ACKLAM_PLOW:
        q = math.sqrt(-2 * math.log(p))
        x = _hp(ACKLAM_C, q) / (_hp(ACKLAM_D, q) * q + 1)
    elif p > 1 - ACKLAM_PLOW:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -_hp(ACKLAM_C, q) / (_hp(ACKLAM_D, q) * q + 1)
    else:
        q = p - 0.5
        r = q * q
        x = _hp(ACKLAM_A, r) * q / (_hp(ACKLAM_B, r) * r + 1)
    e = phi(x) - p
    u = e * SQRT_2PI * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def _hp(coefs, x):
    acc = coefs[0]
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def _lgamma_ratio(big: float, small: float) -> float:
    """ln Γ(big + small) - ln Γ(big) without cancellation for large ``big``."""
    if big < 1e4:
        return math.lgamma(big + small) - math.lgamma(big)
    s = big + small
    return ((big - 0.5) * math.log1p(small / big) + small * math.log(s) - small
            + (1.0 / (12.0 * s) - 1.0 / (12.0 * big)) - (1.0 / (360.0 * s ** 3) - 1.0 / (360.0 * big ** 3)))


def _log_beta(a: float, b: float) -> float:
    """ln B(a, b) = ln Γ(a) + ln Γ(b) - ln Γ(a + b)."""
    big, small = (a, b) if a >= b else (b, a)
    return math.lgamma(small) - _lgamma_ratio(big, small)


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularized incomplete beta I_x(a, b) (continued fraction).

    ``y`` = 1 - x computed by the caller without cancellation, if known.
    """
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    lx = math.log1p(-y) if x > 0.5 else math.log(x)
    ly = math.log1p(-x) if y > 0.5 else math.log(y)
    lbt = -_log_beta(a, b) + a * lx + b * ly
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, y) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student t with ``df`` degrees of freedom."""
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x, t * t / (df + t * t))
    return tail if t > 0 else 1.0 - tail


def t_two_sided_p(t: float, df: float) -> float:
    return min(1.0, 2.0 * t_sf(abs(t), df))


def t_ppf(q: float, df: float) -> float:
    """Student t quantile by bisection on the exact cdf."""
    if q <= 0.0:
        return -math.inf
    if q >= 1.0:
        return math.inf
    if q == 0.5:
        return 0.0
    if q < 0.5:
        return -t_ppf(1.0 - q, df)
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > 1.0 - q:
        hi *= 2.0
        if hi > 1e12:
            return math.inf
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_sf(mid, df) > 1.0 - q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15 * max(1.0, hi):
            break
    return 0.5 * (lo + hi)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution."""
    if math.isnan(f):
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def gammainc_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        term = s = 1.0 / a
        ap = a
        for _ in range(100000):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * 1e-16:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, k: float) -> float:
    if math.isnan(x):
        return math.nan
    if k == 2:
        return math.exp(-x / 2.0)
    return gammainc_upper(k / 2.0, x / 2.0)


#: Largest n for which the distribution of D_n is evaluated exactly.
EXACT_N = 2_000


def kolmogorov_cdf_exact(d: float, n: int) -> float:
    """P(D_n < d) for uniform samples, from the n-th power of a matrix of order
    2k - 1, k = floor(nd) + 1 (Marsaglia, Tsang, Wang 2003). The power is by
    squaring, exponents of ten kept apart."""
    k = int(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    i, j = np.indices((m, m))
    a = np.where(i - j + 1 >= 0, 1.0, 0.0)
    powers = h ** np.arange(1, m + 1)
    a[:, 0] -= powers
    a[m - 1, :] -= powers[::-1]
    a[m - 1, 0] += max(2 * h - 1, 0.0) ** m
    a *= np.exp([[-math.lgamma(max(x, 0) + 1) for x in row] for row in (i - j + 1).tolist()])
    out, scale, base, base_scale, e = np.eye(m), 0, a, 0, n
    while e:
        if e & 1:
            out, scale = out @ base, scale + base_scale
        base, base_scale, e = base @ base, 2 * base_scale, e >> 1
        if base[k - 1, k - 1] > 1e100:
            base, base_scale = base * 1e-100, base_scale + 100
        if out[k - 1, k - 1] > 1e100:
            out, scale = out * 1e-100, scale + 100
    p = float(out[k - 1, k - 1])
    for x in range(1, n + 1):  # times n! / n^n
        p *= x / n
        if p < 1e-100:
            p, scale = p * 1e100, scale - 100
    return float(min(1.0, max(0.0, p * 10.0 ** scale)))


def kolmogorov_sf(d: float, n: int) -> float:
    """P(D_n >= d): exact up to n = EXACT_N, above it the asymptotic Kolmogorov
    series with Stephens' factor. Where n d² is above 18 the value is below
    1e-15 and the series is used at any n."""
    if n <= 0 or math.isnan(d):
        return math.nan
    if d <= 1 / (2 * n):
        return 1.0
    if d >= 1:
        return 0.0
    if n <= EXACT_N and n * d * d <= 18:
        return max(0.0, 1.0 - kolmogorov_cdf_exact(d, n))
    sn = math.sqrt(n)
    lam = (sn + 0.12 + 0.11 / sn) * d
    if lam < 0.2:
        return 1.0
    total, sign = 0.0, 1.0
    for j in range(1, 200):
        term = sign * math.exp(-2.0 * j * j * lam * lam)
        total += term
        if abs(term) < 1e-17:
            break
        sign = -sign
    return max(0.0, min(1.0, 2.0 * total))
