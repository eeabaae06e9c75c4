"""Fixed values that define results. Every table here is stated as text."""

# --- fixed values: providers, horizons, severities, anomaly kinds -----------
CLOUD_PROVIDERS = ["aws", "azure", "gcp"]
SEVERITY_LEVELS = ["low", "medium", "high", "critical"]
FORECAST_HORIZONS = [7, 14, 30, 90]
ANOMALY_TYPES = [
    "point_spike", "sustained_elevation", "gradual_drift", "sudden_drop",
    "multi_service_cascade", "budget_breach", "zero_cost_gap",
    "tag_explosion", "cross_region_transfer_spike", "reserved_instance_expiry",
]

# --- fixed values: currency -> USD rate -------------------------------------
FX_RATES = {
    "USD": 1.0, "EUR": 1.08, "GBP": 1.27, "INR": 0.012,
    "AUD": 0.65, "CAD": 0.74, "JPY": 0.0067, "SGD": 0.74,
}

# --- fixed values: provider service name -> category ------------------------
SERVICE_NAMES = {
    "compute": [
        "amazonec2", "amazon ec2", "virtual machines", "compute engine", "aws lambda",
        "azure functions", "cloud functions", "amazon lightsail", "azure kubernetes service",
        "google kubernetes engine", "amazon eks", "aks",
    ],
    "storage": [
        "amazon s3", "amazon s3 glacier", "azure blob storage", "cloud storage", "amazon ebs",
        "azure disk storage", "persistent disk", "amazon efs", "azure files", "filestore",
    ],
    "database": [
        "amazon rds", "amazon dynamodb", "amazon redshift", "amazon elasticache",
        "azure sql database", "azure cosmos db", "azure cache for redis", "cloud sql",
        "cloud spanner", "cloud bigtable", "bigquery", "firestore",
    ],
    "networking": [
        "amazon vpc", "amazon cloudfront", "amazon route 53", "azure virtual network",
        "azure load balancer", "azure application gateway", "cloud cdn", "cloud dns",
        "cloud load balancing", "aws direct connect", "azure expressroute", "cloud interconnect",
    ],
    "ai_ml": [
        "amazon sagemaker", "amazon rekognition", "amazon comprehend", "azure machine learning",
        "azure cognitive services", "azure openai service", "vertex ai", "cloud ai platform",
    ],
    "monitoring": [
        "amazon cloudwatch", "aws cloudtrail", "azure monitor", "log analytics",
        "cloud monitoring", "cloud logging", "aws config",
    ],
    "security": [
        "aws waf", "aws shield", "aws kms", "amazon guardduty", "azure defender",
        "azure key vault", "cloud armor", "cloud kms", "secret manager",
    ],
    "support": ["aws support", "azure support"],
    "tax": ["tax"],
}
SERVICE_CATEGORY = {name: cat for cat, names in SERVICE_NAMES.items() for name in names}
DEFAULT_SERVICE_CATEGORY = "other"

# --- fixed values: provider region name -> canonical region -----------------
REGION_NAMES = {
    "us-east": ["us-east-1", "us-east-2", "eastus", "eastus2", "us-east1", "us-east4"],
    "us-west": [
        "us-west-1", "us-west-2", "westus", "westus2", "westus3",
        "us-west1", "us-west2", "us-west3", "us-west4",
    ],
    "us-central": ["us-central1", "centralus"],
    "europe-west": [
        "eu-west-1", "eu-west-2", "eu-west-3", "westeurope",
        "europe-west1", "europe-west2", "europe-west4",
    ],
    "europe-central": [
        "eu-central-1", "germanywestcentral", "europe-west3", "europe-west6", "europe-central2",
    ],
    "europe-north": ["eu-north-1", "northeurope", "swedencentral", "europe-north1"],
    "europe-south": ["eu-south-1"],
    "asia-southeast": [
        "ap-southeast-1", "ap-southeast-2", "southeastasia", "asia-southeast1", "asia-southeast2",
    ],
    "asia-northeast": [
        "ap-northeast-1", "ap-northeast-2", "ap-northeast-3", "japaneast", "koreacentral",
        "asia-northeast1", "asia-northeast2",
    ],
    "asia-south": ["ap-south-1", "asia-south1"],
    "asia-east": ["ap-east-1", "eastasia", "asia-east1", "asia-east2"],
    "asia-pacific": ["australiaeast"],
    "south-america": ["sa-east-1", "brazilsouth", "southamerica-east1"],
    "middle-east": ["me-south-1", "uaenorth"],
    "africa": ["af-south-1"],
    "global": ["global"],
}
REGION_CANONICAL = {name: reg for reg, names in REGION_NAMES.items() for name in names}
DEFAULT_REGION = "unknown"

# --- fixed values: tag keys by priority and environment aliases --------------
ENVIRONMENT_KEYS = ["environment", "env", "stage", "tier"]
ENVIRONMENT_ALIASES = {
    "prod": "prod", "production": "prod",
    "staging": "staging", "stage": "staging", "stg": "staging",
    "dev": "dev", "development": "dev",
    "test": "test", "testing": "test", "qa": "test",
}
TEAM_KEYS = ["team", "owner", "squad", "department", "cost_center", "project", "app"]

# --- fixed values: detection -------------------------------------------------
SEVERITY_THRESHOLDS = {"low": 0.30, "medium": 0.50, "high": 0.70, "critical": 0.90}
ENSEMBLE_WEIGHTS = {"zscore": 0.45, "iforest": 0.55, "sequence": 0.00}
FOREST_TREES = 200
FOREST_SUBSAMPLE = 256
FOREST_SEED = 42
FOREST_FEATURES = [
    "rolling_mean_7d", "rolling_std_7d", "rolling_mean_30d", "rolling_std_30d",
    "pct_change_1d", "pct_change_7d", "cost_lag_1d", "cost_lag_7d", "cost_lag_30d",
    "day_of_week", "is_month_end", "is_weekend",
]
SEQUENCE_LENGTH = 30
SEQUENCE_FEATURES = [
    "rolling_mean_7d", "rolling_std_7d", "rolling_mean_30d", "pct_change_1d",
    "pct_change_7d", "cost_lag_1d", "cost_lag_7d", "cost_lag_30d",
]
SEQUENCE_ERROR_PERCENTILE = 0.95
SEQUENCE_LEAST_COLUMNS = 3

# --- fixed values: smallest group sizes --------------------------------------
MIN_ROWS = {
    "detection_run": 30, "iforest": 30, "sequence": 90, "sequence_train": 31,
    "boosted": 45, "seasonal": 60, "attribution": 45,
}

# --- fixed values: forecasting -----------------------------------------------
TRAIN_RATIO, VAL_RATIO = 0.70, 0.15
BLEND_DEFAULT_WEIGHTS = (0.45, 0.55)      # seasonal, boosted
INTERVAL_Z = 1.96
SEASONAL_CHANGEPOINT_PRIOR, SEASONAL_SEASONALITY_PRIOR = 0.05, 10.0
SEASONAL_YEARLY_ORDER, SEASONAL_WEEKLY_ORDER = 10, 3
BOOSTED_LEARNING_RATE, BOOSTED_MAX_TREES = 0.05, 500
BOOSTED_FEATURES = [
    "lag_1d", "lag_7d", "lag_30d", "rolling_mean_7d", "rolling_mean_30d",
    "rolling_std_7d", "rolling_std_30d", "pct_change_7d", "day_of_week",
    "is_weekend", "is_month_end", "month", "quarter",
]

# --- fixed values: attribution -----------------------------------------------
ATTRIBUTION_FEATURES = [
    "cost_lag_1d", "cost_lag_7d", "cost_lag_30d",
    "rolling_mean_7d", "rolling_std_7d", "rolling_mean_30d", "rolling_std_30d",
    "pct_change_1d", "pct_change_7d", "pct_change_30d", "z_score_30d",
    "day_of_week", "day_of_month", "week_of_year", "month",
    "is_weekend", "is_month_start", "is_month_end", "record_count",
]

# --- fixed values: alerting ---------------------------------------------------
SPEND_SPIKE_PCT = 50.0
SPEND_SPIKE_HIGH_PCT = 100.0
BUDGET_WARNING_PCT = 85.0
BUDGET_BREACH_PCT = 100.0
MONTHLY_BUDGET_USD = {"aws": 180000.0, "azure": 160000.0, "gcp": 140000.0}

# --- fixed values: default report window and ingestion start ------------------
DEFAULT_BOUNDS = ("2023-01-01", "2024-12-31")
INGESTION_START = "2023-01-01"
FETCH_WINDOW_DAYS = 30

# --- fixed values: plain-language feature names -------------------------------
FEATURE_DESCRIPTIONS = {
    "cost_lag_1d": "yesterday's cost level",
    "cost_lag_7d": "cost level 7 days ago",
    "cost_lag_30d": "cost level 30 days ago",
    "rolling_mean_7d": "7-day average spend",
    "rolling_mean_30d": "30-day average spend",
    "rolling_std_7d": "spend volatility over 7 days",
    "rolling_std_30d": "spend volatility over 30 days",
    "pct_change_1d": "day-over-day % change",
    "pct_change_7d": "week-over-week % change",
    "pct_change_30d": "month-over-month % change",
    "z_score_30d": "how far costs deviate from the 30-day norm",
    "day_of_week": "day of week effect",
    "day_of_month": "day of month effect",
    "week_of_year": "week of year seasonality",
    "month": "monthly seasonality",
    "is_weekend": "weekend usage pattern",
    "is_month_start": "start-of-month billing pattern",
    "is_month_end": "end-of-month billing pattern",
    "record_count": "number of billing line items",
}
