"""Standard normal distribution function and its inverse as Column expressions.

Published double-precision rational approximations: G. West, "Better approximations to cumulative
normal functions" (2005), and M. Wichura, algorithm AS 241 (1988).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# West's numerator and denominator, highest power first.
CDF_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
CDF_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
CDF_SPLIT = 7.07106781186547
CDF_SCALE = 2.506628274631

# The three AS 241 branches, highest power first.
PPF_A = [
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
    1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
]
PPF_B = [
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
    5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
]
PPF_C = [
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
    3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
]
PPF_D = [
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
]
PPF_E = [
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
    2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
]
PPF_F = [
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
    1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
]


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Horner evaluation, highest power first."""
    acc = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def normal_cdf(x: Column) -> Column:
    """P(Z <= x)."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    near = density * polynomial(CDF_NUM, a) / polynomial(CDF_DEN, a)
    fraction = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = density / fraction / F.lit(CDF_SCALE)
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < CDF_SPLIT, near).otherwise(far)
    return F.when(x > 0, 1.0 - upper).when(x <= 0, upper)


def normal_ppf(p: Column) -> Column:
    """The z with P(Z <= z) = p; null outside (0, 1)."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * polynomial(PPF_A, r) / polynomial(PPF_B, r)
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1.0 - p)))
    mid, out = tail - 1.6, tail - 5.0
    size = F.when(tail <= 5.0, polynomial(PPF_C, mid) / polynomial(PPF_D, mid)).otherwise(
        polynomial(PPF_E, out) / polynomial(PPF_F, out)
    )
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).when(q < 0, -size).otherwise(size))
