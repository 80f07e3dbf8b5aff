"""Parameters of the registered queries (one place, used by Spark and SQL)."""

# Fixed values that must equal the reference's settings.
GAMMA = 0.8          # DUCB discount
SLOTS = 10           # picks per DUCB decision
BONUS = 1000.0       # DUCB exploration scale
EPSILON = 0.9        # epsilon-greedy explore probability
BLOCK = 100          # records per block in the failover report
MANAGED_LABELS = 2   # trailing labels not sampled by the histogram
SAMPLE_FRACTION = 0.01
# Session labels of the test fixture's update text and the reduced list.
UPDATE_LABELS = ["EventId", "K", "Shard", "decision", "socre"]
REDUCED_LABELS = ["decision", "socre"]

# Choices for the test data (sparse: ~14 events per hour at sf0.01).
TICK_S = 21600       # 6-hour ticks
EG_WINDOW_TICKS = 4  # epsilon-greedy window: one day of ticks
SECOND_S = 3600      # replay "second" bucket
MINUTE_S = 86400     # replay "minute" bucket
ME = "c0"            # this cluster
SEED = "qoe"         # seed of the reproducible draws
N_FRONTENDS = 2
DECISION_TYPES = ["click", "error", "purchase", "signup", "view"]
SNAPSHOT_BACK = [8, 4, 0]   # V.decisions: ticks before the last one
ORIGIN = "From: c0"
REQUEST_BACK = 10     # first tick of the timed requests, before the last tick
REQUEST_TICKS = 14    # ticks over which they are spread
BETA_LIMIT = 50.0     # mean cost up to which a tick counts as good
SUB_TTL_S = 10800     # seconds a subscription lasts without renewal
METRIC_LATENESS_S = 43200   # lateness of the measured stream
LATE_SLICES = 3       # micro-batches of the out-of-order stream
