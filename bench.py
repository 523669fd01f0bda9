"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridloom import registry  # noqa: E402
from gridloom.session import local_session  # noqa: E402

HEADLINES = [
    "kpi1_global", "kpi2_trend", "kpi3_top_regions", "kpi5_channel", "kpi6_top_products", "kpi7_promo_split", "kpi8_promo_rate", "dim_produit", "fact_ventes_A", "dash_dg_monthly", "agg_resample", "agg_quantile", "fe_standardize",
    "eda_corr_matrix", "ml_knn_cls", "ml_gnb", "ev_roc_auc", "pt_equalize", "ed_sobel_norm", "cv_gauss", "ff_lowpass", "sg_otsu", "bn_ccl", "bn_hysteresis", "grp_c05", "st_tumbling",
]


def main() -> None:
    sf_dir, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    queries = registry.queries()
    queries["kpi1_global"](spark, sf_dir).collect()  # starts the session and its code generation
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
