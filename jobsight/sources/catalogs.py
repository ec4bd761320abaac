"""Price and node catalogs: small dimension tables held in code.

All of them are fixed values. Lookups by key are maps and lookups by range are
unrolled conditions, so that neither needs a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# instance_type, provider, vcpus, memory_gb, hourly_price, local_storage_gb
PRICES = [
    ("m5.large", "aws", 2, 8.0, 0.096, 0),
    ("m5.xlarge", "aws", 4, 16.0, 0.192, 0),
    ("m5.2xlarge", "aws", 8, 32.0, 0.384, 0),
    ("m5.4xlarge", "aws", 16, 64.0, 0.768, 0),
    ("r5.large", "aws", 2, 16.0, 0.126, 0),
    ("r5.xlarge", "aws", 4, 32.0, 0.252, 0),
    ("r5.2xlarge", "aws", 8, 64.0, 0.504, 0),
    ("c5.large", "aws", 2, 4.0, 0.085, 0),
    ("c5.xlarge", "aws", 4, 8.0, 0.170, 0),
    ("c5.2xlarge", "aws", 8, 16.0, 0.340, 0),
    ("i3.xlarge", "aws", 4, 30.5, 0.312, 950),
    ("i3.2xlarge", "aws", 8, 61.0, 0.624, 1900),
    ("n1-standard-2", "gcp", 2, 7.5, 0.095, 0),
    ("n1-standard-4", "gcp", 4, 15.0, 0.190, 0),
    ("n1-standard-8", "gcp", 8, 30.0, 0.380, 0),
    ("n1-standard-16", "gcp", 16, 60.0, 0.760, 0),
    ("n1-highmem-2", "gcp", 2, 13.0, 0.118, 0),
    ("n1-highmem-4", "gcp", 4, 26.0, 0.237, 0),
    ("n1-highmem-8", "gcp", 8, 52.0, 0.473, 0),
    ("n1-highcpu-4", "gcp", 4, 3.6, 0.142, 0),
    ("n1-highcpu-8", "gcp", 8, 7.2, 0.284, 0),
    ("n2-standard-4", "gcp", 4, 16.0, 0.194, 0),
    ("n2-standard-8", "gcp", 8, 32.0, 0.388, 0),
    ("Standard_D2s_v3", "azure", 2, 8.0, 0.096, 0),
    ("Standard_D4s_v3", "azure", 4, 16.0, 0.192, 0),
    ("Standard_D8s_v3", "azure", 8, 32.0, 0.384, 0),
    ("Standard_D16s_v3", "azure", 16, 64.0, 0.768, 0),
    ("Standard_E2s_v3", "azure", 2, 16.0, 0.126, 0),
    ("Standard_E4s_v3", "azure", 4, 32.0, 0.252, 0),
    ("Standard_E8s_v3", "azure", 8, 64.0, 0.504, 0),
    ("Standard_F4s_v2", "azure", 4, 8.0, 0.169, 0),
    ("Standard_F8s_v2", "azure", 8, 16.0, 0.338, 0),
]
PRICE_COLUMNS = ["instance_type", "provider", "vcpus", "memory_gb", "hourly_price", "local_storage_gb"]

# Providers in order, share of the on-demand price paid for spot and for one-year reserved capacity
PROVIDERS = ["aws", "gcp", "azure"]
SPOT_FACTORS = {"aws": 0.3, "gcp": 0.2, "azure": 0.35, "generic": 0.3}
RESERVED_FACTORS = {"aws": 0.6, "gcp": 0.57, "azure": 0.58, "generic": 0.6}
DEFAULT_SPOT, DEFAULT_RESERVED = 0.3, 0.6
# Instance price tiers that do not depend on the provider
TIER_FACTORS = {"reserved_1y": 0.6, "reserved_3y": 0.4}
SPOT_TIERS = ["spot", "preemptible"]

# Price of a region relative to the base region
REGION_FACTORS = {
    "aws": {
        "us-east-1": 1.0,
        "us-west-2": 1.0,
        "eu-west-1": 1.05,
        "eu-central-1": 1.08,
        "ap-northeast-1": 1.15,
        "ap-southeast-1": 1.10,
        "sa-east-1": 1.25,
    },
    "gcp": {
        "us-central1": 1.0,
        "us-east1": 1.0,
        "europe-west1": 1.05,
        "europe-west4": 1.08,
        "asia-northeast1": 1.15,
        "asia-southeast1": 1.10,
    },
    "azure": {
        "eastus": 1.0,
        "westus2": 1.0,
        "northeurope": 1.05,
        "westeurope": 1.08,
        "japaneast": 1.15,
        "southeastasia": 1.10,
    },
}
# Regions a comparison looks at
COMPARED_REGIONS = {
    "aws": ["us-east-1", "us-west-2", "eu-west-1", "ap-northeast-1"],
    "gcp": ["us-central1", "us-east1", "europe-west1", "asia-northeast1"],
    "azure": ["eastus", "westus2", "northeurope", "japaneast"],
}
# Reliability score of a provider
RELIABILITY = {"aws": 0.95, "gcp": 0.93, "azure": 0.94}

# node_type, cores, memory_gb, price per hour (vendor A: step clusters)
STEP_NODES = [
    ("m5.xlarge", 4, 16.0, 0.192),
    ("m5.2xlarge", 8, 32.0, 0.384),
    ("m5.4xlarge", 16, 64.0, 0.768),
    ("m5.8xlarge", 32, 128.0, 1.536),
    ("m5.12xlarge", 48, 192.0, 2.304),
    ("m5.16xlarge", 64, 256.0, 3.072),
    ("r5.xlarge", 4, 32.0, 0.252),
    ("r5.2xlarge", 8, 64.0, 0.504),
    ("r5.4xlarge", 16, 128.0, 1.008),
    ("r5.8xlarge", 32, 256.0, 2.016),
    ("r5.12xlarge", 48, 384.0, 3.024),
    ("c5.xlarge", 4, 8.0, 0.17),
    ("c5.2xlarge", 8, 16.0, 0.34),
    ("c5.4xlarge", 16, 32.0, 0.68),
    ("c5.9xlarge", 36, 72.0, 1.53),
]

# node_type, cores, memory_gb, units per hour (vendor B: run clusters)
RUN_NODES = [
    ("Standard_DS3_v2", 4, 14.0, 0.75),
    ("Standard_DS4_v2", 8, 28.0, 1.5),
    ("Standard_DS5_v2", 16, 56.0, 3.0),
    ("Standard_E4s_v3", 4, 32.0, 1.0),
    ("Standard_E8s_v3", 8, 64.0, 2.0),
    ("Standard_E16s_v3", 16, 128.0, 4.0),
    ("Standard_F4s", 4, 8.0, 0.6),
    ("Standard_F8s", 8, 16.0, 1.2),
    ("Standard_F16s", 16, 32.0, 2.4),
    ("i3.xlarge", 4, 30.5, 0.75),
    ("i3.2xlarge", 8, 61.0, 1.5),
    ("i3.4xlarge", 16, 122.0, 3.0),
    ("r5d.xlarge", 4, 32.0, 0.9),
    ("r5d.2xlarge", 8, 64.0, 1.8),
    ("r5d.4xlarge", 16, 128.0, 3.6),
]

# node_type, cores, memory_gb, price per hour (vendor C: job clusters)
JOB_NODES = [
    ("n1-standard-4", 4, 15.0, 0.19),
    ("n1-standard-8", 8, 30.0, 0.38),
    ("n1-standard-16", 16, 60.0, 0.76),
    ("n1-standard-32", 32, 120.0, 1.52),
    ("n1-highmem-4", 4, 26.0, 0.24),
    ("n1-highmem-8", 8, 52.0, 0.47),
    ("n1-highmem-16", 16, 104.0, 0.94),
    ("n1-highmem-32", 32, 208.0, 1.87),
    ("n1-highcpu-4", 4, 3.6, 0.14),
    ("n1-highcpu-8", 8, 7.2, 0.28),
    ("n1-highcpu-16", 16, 14.4, 0.56),
    ("n1-highcpu-32", 32, 28.8, 1.13),
    ("n2-standard-4", 4, 16.0, 0.19),
    ("n2-standard-8", 8, 32.0, 0.39),
    ("n2-standard-16", 16, 64.0, 0.78),
    ("n2-standard-32", 32, 128.0, 1.55),
    ("n2-highmem-4", 4, 32.0, 0.26),
    ("n2-highmem-8", 8, 64.0, 0.52),
    ("n2-highmem-16", 16, 128.0, 1.04),
    ("e2-standard-4", 4, 16.0, 0.13),
    ("e2-standard-8", 8, 32.0, 0.27),
    ("e2-standard-16", 16, 64.0, 0.54),
    ("c2-standard-4", 4, 16.0, 0.21),
    ("c2-standard-8", 8, 32.0, 0.42),
    ("c2-standard-16", 16, 64.0, 0.85),
]
NODE_COLUMNS = ["node_type", "cores", "memory_gb", "rate"]


def prices(spark: SparkSession) -> DataFrame:
    """Price catalog with its position, which breaks ties."""
    rows = [(i, *p) for i, p in enumerate(PRICES)]
    return spark.createDataFrame(
        rows,
        "position int, instance_type string, provider string, vcpus int, memory_gb double, hourly_price double,"
        " local_storage_gb int",
    )


def nodes(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "node_type string, cores int, memory_gb double, rate double")


def regions(spark: SparkSession) -> DataFrame:
    rows = [(p, r, f) for p, by_region in REGION_FACTORS.items() for r, f in by_region.items()]
    return spark.createDataFrame(rows, "provider string, region string, region_factor double")


def lookup(values: dict[str, float], key: Column | str, default: float | None = None) -> Column:
    """Value of a small code table for a column, or the default."""
    entries = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.element_at(F.create_map(*entries), F.col(key) if isinstance(key, str) else key)
    return found if default is None else F.coalesce(found, F.lit(default))
