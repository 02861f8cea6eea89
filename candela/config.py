"""Parameters shared by the operators. Fixed values that results depend on."""

PERIODS = 365
MAX_FILL_DAYS = 5
MIN_ROWS_AFTER_TRIM = 60
FEE = 0.001
SLIPPAGE = 0.001
RISK_FREE = {"usd": 0.04, "brl": 0.14, "eur": 0.02}
# Standard normal quantiles (statistics.NormalDist().inv_cdf) of 0.05, 0.01, 0.90 and 0.975.
Z05, Z01, Z80, Z95 = -1.6448536269514729, -2.3263478740408408, 1.2815515655446008, 1.9599639845400536
EPSILON = 1e-12
