"""Fixed values that must equal the reference's behaviour, kept together in
natural order as plain text: labels, bin edges, thresholds, report sizes,
fill values, model settings.  Operators import them from here."""

# --- calendar, buckets, tiers and labels ----------------------------------
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEEKEND_DAYS = [0, 6]
PEAK_HOURS = (10, 16)                      # inclusive
PEAK_DAYS = [0, 1, 6]                      # Sunday, Monday, Saturday
HOUR_BUCKETS = [(6, "night"), (12, "morning"), (18, "afternoon"), (24, "evening")]   # right-closed, 0 included
DAYS_BUCKETS = [(0, "first_order"), (7, "week"), (14, "two_weeks"), (30, "month")]    # right-closed; above -> long_time
ORDER_GROUP_BINS = [(0, 5, "1-5"), (5, 10, "6-10"), (10, 20, "11-20"), (20, 100, "20+")]  # (lo, hi]
FREQUENCY_BINS = [(1, 5, "1-4"), (5, 10, "5-9"), (10, 20, "10-19"), (20, 50, "20-49"), (50, 100, "50+")]  # [lo, hi)
TIERS = [(5, "Light Users"), (10, "Medium Users")]     # <= bound; else Heavy Users
JOURNEY = [(1, "One-time Buyer"), (5, "New Customer"), (15, "Regular Customer")]   # <= bound; else Loyal Customer
CONFIDENCE = [(0.8, "high"), (0.6, "medium")]              # > bound; else low
RECENCY_BANDS = [(90, "0-90"), (180, "91-180"), (365, "181-365")]   # <= bound; else >365
SEGMENTS = [("All Users", None, None), ("New Users (1-5 orders)", None, 5),
            ("Regular Users (6-20 orders)", 6, 20), ("Heavy Users (20+ orders)", 20, None)]  # order_number bounds, inclusive
RECENCY_LABELS = ["High", "Medium-High", "Medium-Low", "Low"]       # quartiles of mean gap, ascending
FREQUENCY_LABELS = ["Low", "Medium-Low", "Medium-High", "High"]     # quartiles of order count, ascending
PEAK_LABELS = ["Peak Hours (10-16)", "Off-Peak Hours", "Peak Days (Sun,Mon,Sat)", "Off-Peak Days"]
RECENCY_FILL = 30.0
SYNTHETIC_EPOCH = "2023-01-01"
UNKNOWN_PRODUCT = "Unknown Product"
HASH_MULTIPLIER = 2654435761               # Knuth multiplicative hash, modulo 2^32
HASH_MODULUS = 4294967296

# --- report sizes and thresholds -------------------------------------------
TOP_PRODUCTS = 10                 # A13, W5, W6
TOP_DEPARTMENTS = 5               # A14
MIN_ORDERS_FOR_RATE = 10          # W6
LOYAL_MIN_ORDERS = 10             # A30
RETENTION_ORDER_NUMBER = 5        # A11: any order number above it
HIGH_REORDER_RATE = 0.8           # A19
LOW_REORDER_RATE = 0.3            # A19
RATE_DECIMALS = 3                 # A19 rounding (half-even)
GAP_BINS = 30                     # A31
BASKET_BINS = 30                  # A31 basket size, prior and train
DIST_BINS = 20                    # A31 orders per user, reorder rate, mean gap
LABEL_HIST_BINS = 50              # A31 per label value
IQR_FACTOR = 1.5                  # Q17
Z_LIMIT = 3.0                     # Q17
LOW_CARDINALITY_RATIO = 0.5       # Q16
SAMPLE_ROWS = 5                   # Q3
SAMPLE_MAX_TABLE_ROWS = 1000      # Q3

# --- features ---------------------------------------------------------------
NEVER_BOUGHT_DAYS = 999           # P21: days_since for pairs without history

# --- evaluation ---------------------------------------------------------------
RANKING_KS = (5, 10, 20, 50)      # E10
GLOBAL_KS = (10, 20, 50)          # E12
THRESHOLD = 0.5                   # E10 / M19
RECOMMEND_K = 10                  # W7
DEMO_SAMPLE_ROWS = 10000          # M20
DEMO_SEED = 42

# --- models -----------------------------------------------------------------
#: The stored feature contract, in its order.
MODEL_FEATURES = [
    "user_total_orders_x", "user_avg_days_between_orders", "user_min_days_between_orders", "user_max_days_between_orders",
    "user_std_days_between_orders", "user_preferred_hour", "user_preferred_dow", "user_total_products", "user_avg_basket_size",
    "user_unique_products", "user_reorder_rate", "aisle_id", "department_id", "product_total_orders", "product_reorder_rate",
    "product_reorder_count", "product_total_purchases", "product_avg_cart_position", "product_preferred_hour",
    "product_preferred_dow", "product_unique_users", "up_orders_count", "up_reorder_count", "up_avg_cart_position",
    "up_last_order_number", "user_max_order_number", "up_days_since_last_purchase", "user_total_orders_y", "up_order_rate",
    "up_reorder_rate"]
SPLIT_SEED = 42                   # M2
TRAIN_FRACTION = 0.8              # M2
LR_MAX_ITER = 1000                # M12
LR_C = 1.0
LR_TOL = 1e-4
GBT_TREES = 100                   # M13
GBT_DEPTH = 6
GBT_LEARNING_RATE = 0.1
RF_TREES = 100                    # M9 / M15
MLP_HIDDEN = (512, 256, 128)      # M14
MLP_EPOCHS = 50
ENSEMBLE_WEIGHTS = (0.6, 0.4)     # M15
IMPORTANCE_WEIGHTS = (0.6, 0.4)   # M10: forest importance, |correlation|
TOP_CORRELATED = 10               # M8
K_BEST = 100                      # M5; all features where there are fewer
SELECT_BEST = 10                  # M6: features that a univariate report lists
CV_FOLDS = 5                      # M16: expanding folds by order number
VOTING_WEIGHTS = {"xgboost": 0.4, "mlp": 0.3, "lstm": 0.2, "tcn": 0.1}     # M16
