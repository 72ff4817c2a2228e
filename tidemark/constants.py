"""Fixed values of the study; results depend on them matching exactly."""

RISK_FREE = 0.04
STRIKE_WINDOW = 0.25
MAX_STALE_SESSIONS = 3
SPOT_LOOKBACK_DAYS = 7
BUCKETS = {"1m": (21, 45, 30), "2m": (46, 80, 60), "3-6m": (90, 180, 120)}
BASELINE_BUCKET = "3-6m"
HORIZONS = (1, 2, 3, 5, 10, 21, 42, 63)
OTM_GRID = (0.03, 0.05, 0.10)
OTM = 0.05
ENTRY = "post"
STRATEGIES = ("stock", "long_call", "covered_call", "protective_put", "collar", "cash_secured_put")
STRATEGY_LEGS = {"stock": ("C_K", "P_K"), "long_call": ("C_K",), "covered_call": ("C_K", "P_K", "C_U"),
                 "protective_put": ("C_K", "P_K", "P_L"), "collar": ("C_K", "P_K", "C_U", "P_L"),
                 "cash_secured_put": ("P_L",)}
COST_HAIRCUT = 0.05
RISK_FRACTION = 0.01
PARTICIPATION = 0.05
CAPITAL = 100_000.0
PLACEBO_GAP_DAYS = 30
PLACEBO_N = 120
EULER_GAMMA = 0.5772156649015329
SESSIONS_PER_YEAR = 252
