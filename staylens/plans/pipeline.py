"""End-to-end batch build: raw sources -> clean frames -> enriched fact -> rollup.

One ``Pipeline`` per (session, input folder, configuration).  The heavy steps —
key dedup of bookings and of cancellations, and their join — each run once and
are written to the shared checkpoint folder (``materialize``); every query on
clean rows reads those tables.  The (segment, day, season)
rollup is written from that fact in one more pass; views and metrics read the
rollup, row-grain queries read the fact, both with column pruning and
pushed-down filters.

Broadcast decisions are size-checked with numbers observed during those
writes, never guessed:

* pricing: its exact row count (observed while it is written);
* daily occupancy totals: at most one row per calendar day between the
  observed min and max check-in dates.

The same writes observe the cleaning step counts (``cleaning_counts``),
the join diagnostics in ``stats`` (rows without a season, rates still missing,
unknown lead times), so reporting costs no extra pass.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, Config
from staylens.operators import clean as C
from staylens.operators import fact as FT
from staylens.operators import views as V
from staylens.plans.materialize import materialize
from staylens.sources import fixtures


@dataclass
class Pipeline:
    """Lazy, memoised stages of one build.

    ``sf_dir`` points at the driver tables (the raw sources are derived from
    them); ``Pipeline.from_frames`` starts from raw string frames instead,
    e.g. the CSV scans of ``staylens.sources.csv.read_all``.
    """

    spark: SparkSession
    sf_dir: str
    cfg: Config = DEFAULT_CONFIG
    stats: dict = field(default_factory=dict)
    sources: dict[str, DataFrame] | None = None
    #: Contract report of the scan (source -> missing columns), if known.
    missing: dict[str, list[str]] = field(default_factory=dict)
    #: Raw rows that the scan set aside (source -> rows), if counted.
    set_aside: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_frames(
        cls,
        bookings: DataFrame,
        cancellations: DataFrame,
        pricing: DataFrame,
        cfg: Config = DEFAULT_CONFIG,
        missing: dict[str, list[str]] | None = None,
        set_aside: dict[str, int] | None = None,
    ) -> "Pipeline":
        """Start from raw string frames, e.g. ``frames, missing, set_aside = csv.read_all(...)``."""
        frames = {"bookings": bookings, "cancellations": cancellations, "pricing": pricing}
        report, left_out = dict(missing or {}), dict(set_aside or {})
        for known in (report, left_out):
            if "seasonal_pricing" in known:
                known["pricing"] = known.pop("seasonal_pricing")
        return cls(bookings.sparkSession, "", cfg, sources=frames, missing=report, set_aside=left_out)

    def _raw(self, name: str, derive) -> DataFrame:
        df = self.sources[name] if self.sources is not None else derive(self.spark, self.sf_dir)
        return C.null_tokens(df, self.cfg)

    # -- raw (as read: exact missing-value tokens become null) ---------------
    @cached_property
    def raw_bookings(self) -> DataFrame:
        return self._raw("bookings", fixtures.raw_bookings)

    @cached_property
    def raw_cancellations(self) -> DataFrame:
        return self._raw("cancellations", fixtures.raw_cancellations)

    @cached_property
    def raw_pricing(self) -> DataFrame:
        return self._raw("pricing", fixtures.raw_pricing)

    # -- clean (written once; every later stage and query reads the written tables) --
    @cached_property
    def bookings_clean(self) -> DataFrame:
        """Materialised; the raw rows per key and the step counts come out of the same pass."""
        parsed = C.dedup_parse_bookings(self.raw_bookings, self.cfg, count_as="__rows", keep_raw=True)
        has_dates = F.col("check_in_date").isNotNull() & F.col("booking_date").isNotNull()
        # counters sit on the frame that the one write consumes, after the exchange
        obs = Observation(f"bookings_{uuid.uuid4().hex[:8]}")
        parsed = parsed.observe(
            obs,
            F.sum("__rows").alias("raw"),
            F.count(F.lit(1)).alias("key_dedup"),
            F.count_if(has_dates).alias("dates_present"),
            F.count_if(has_dates & C.valid_stay()).alias("valid_stay"),
            *[v.alias(k) for k, v in C.booking_fills(self.cfg).items()],
        )
        parsed = parsed.drop("__rows", *[f"__raw_{c}" for c in C.BOOKING_DATES])
        df, _ = materialize(C.finish_bookings(parsed, self.cfg), "bookings_clean",
                            {"rows": F.count(F.lit(1))}, bucket_by="reservation_id")
        self.stats["cleaning_bookings"] = {k: int(v or 0) for k, v in obs.get.items()}
        return df

    @cached_property
    def cancellations_clean(self) -> DataFrame:
        dedup = C.dedup_cancellations(self.raw_cancellations, self.cfg, count_as="__rows")
        obs = Observation(f"cancellations_{uuid.uuid4().hex[:8]}")
        dedup = dedup.observe(
            obs,
            F.sum("__rows").alias("raw"),
            F.count(F.lit(1)).alias("key_dedup"),
            F.count_if(F.col("__cancellation_date").isNotNull()).alias("dates_present"),
            *[v.alias(k) for k, v in C.cancellation_fills().items()],
        )
        df, _ = materialize(C.finish_cancellations(dedup.drop("__rows"), self.cfg), "cancellations_clean",
                            {"rows": F.count(F.lit(1))}, bucket_by="reservation_id")
        self.stats["cleaning_cancellations"] = {k: int(v or 0) for k, v in obs.get.items()}
        return df

    def cleaning_counts(self) -> dict[str, dict[str, int]]:
        """C18 for a pipeline run: rows kept per cleaning step, observed while the clean
        tables were written (no extra pass, and no other action can disturb
        them).  Exact-duplicate counts need their own grouping pass; see
        ``clean.cleaning_report``.  Sources whose scan counted the rows it set
        aside have that number as ``set_aside``.
        """
        self.fact_base  # noqa: B018 - the writes of the build fill the counts
        counts = {"bookings": dict(self.stats["cleaning_bookings"]), "cancellations": dict(self.stats["cleaning_cancellations"])}
        for source, n in self.set_aside.items():
            counts.setdefault(source, {})["set_aside"] = n
        return counts

    def row_counts(self) -> dict[str, int]:
        """Rows of the raw, clean and fact tables, as observed while they were written."""
        counts = self.cleaning_counts()
        return {"raw_bookings": counts["bookings"]["raw"], "raw_cancellations": counts["cancellations"]["raw"],
                "bookings_clean": counts["bookings"]["valid_stay"], "fact": self.stats["fact_rows"]}

    @cached_property
    def pricing_clean(self) -> DataFrame:
        """Materialised: a small calendar dimension, counted while written."""
        df, m = materialize(C.clean_pricing(self.raw_pricing, self.cfg), "pricing_clean",
                            {"rows": F.count(F.lit(1))})
        self.stats["pricing_rows"] = int(m["rows"])
        return df

    # -- fact -----------------------------------------------------------------
    @cached_property
    def fact_base(self) -> DataFrame:
        """J1 → J2 → F1/F2/F4, written once; bounds observed in the same pass."""
        pricing = self.pricing_clean
        if self.cfg.strict_joins:
            dup = FT.join_fanout_check(self.spark.createDataFrame([], "reservation_id string"), pricing)
            extra = dup.filter(F.col("join_name") == "pricing").first()["extra_rows"]
            if extra:
                raise ValueError(f"pricing has {extra} extra rows on duplicated days; the fact would fan out")
        broadcast_pricing = self.stats["pricing_rows"] <= self.cfg.broadcast_max_rows
        base = FT.fact_base(self.bookings_clean, self.cancellations_clean, pricing,
                            broadcast_pricing=broadcast_pricing)
        by_month = ["check_in_month"] if self.cfg.partition_fact_by_month else None
        if by_month:
            from staylens.sources.sinks import by_month as dealt

            base = dealt(base)
        df, m = materialize(
            base,
            "fact_base",
            {
                "rows": F.count(F.lit(1)),
                "min_check_in": F.min("check_in_date"),
                "max_check_in": F.max("check_in_date"),
                "cancelled": F.count_if("is_cancelled"),
                # join diagnostics the original logs, observed on the same write
                "no_season": F.count_if(F.col("season_tag").isNull()),
                "rate_still_null": F.count_if(F.col("rate").isNull()),
                "lead_unknown": F.count_if(F.col("lead_time_days").isNull()),
            },
            sort_within=["check_in_date"],
            partition_by=by_month,
        )
        if by_month:
            df = df.drop("check_in_month")
        extra = int(m["rows"]) - self.stats["cleaning_bookings"]["valid_stay"]
        if extra:  # counts that are in hand: the check that the original logs after each join
            warnings.warn(f"the joins made {extra} more rows than there are bookings; join_fanout_check names the repeated keys", stacklevel=2)
        self.stats.update(
            fact_fanout_rows=extra,
            fact_rows=int(m["rows"]),
            fact_cancelled=int(m["cancelled"]),
            fact_no_season=int(m["no_season"]),
            fact_rate_still_null=int(m["rate_still_null"]),
            fact_lead_unknown=int(m["lead_unknown"]),
            min_check_in=m["min_check_in"],
            max_check_in=m["max_check_in"],
            broadcast_pricing=broadcast_pricing,
        )
        return df

    @cached_property
    def daily_days_bound(self) -> int:
        """Upper bound on the rows of the daily occupancy aggregate."""
        self.fact_base  # noqa: B018 - ensures the bounds are observed
        lo, hi = self.stats["min_check_in"], self.stats["max_check_in"]
        return 0 if lo is None else (hi - lo).days + 1

    @cached_property
    def fact(self) -> DataFrame:
        """the enriched fact: base Parquet ⟕ daily totals (from the written rollup, so the base is scanned once)."""
        base = self.fact_base
        small = self.daily_days_bound <= self.cfg.broadcast_max_rows
        self.stats["broadcast_daily"] = small
        daily = (
            self.segment_daily.filter("n_active > 0")
            .groupBy(F.col("date").alias("check_in_date"))
            .agg(F.coalesce(F.sum("active_room_nights"), F.lit(0)).alias("__daily_booked"))
        )
        return FT.order_fact_columns(FT.add_occupancy_rate(base, self.cfg, daily=daily, broadcast=small))

    @cached_property
    def fact_segmented(self) -> DataFrame:
        return V.segmented(self.fact, self.cfg)

    @cached_property
    def segment_daily(self) -> DataFrame:
        """The (segment, day, season) rollup every view and metric reads; written once.

        Its size is bounded by segments × days × seasons, not by bookings.
        """
        df, m = materialize(V.segment_daily(V.segmented(self.fact_base, self.cfg)), "segment_daily",
                            {"rows": F.count(F.lit(1))}, sort_within=["segment_name", "date"])
        self.stats["daily_rows"] = int(m["rows"])
        return df


    def write_outputs(self, base: str) -> dict[str, int]:
        """Write every stage's output under ``base`` (full replace) and return row counts.

        ``interim/`` clean bookings, cancellations and pricing (S7);
        ``processed/fact_bookings_enriched`` partitioned by check-in month (S8);
        ``load/`` the typed fact and the segment dimension, with the read-back
        count checked (S9).  ``base`` should be a shared folder on a cluster.
        """
        from staylens.operators import dims as D
        from staylens.sources import sinks

        base = base.rstrip("/")
        counts = {
            "bookings_clean": sinks.write_table(self.bookings_clean, f"{base}/interim/bookings_clean"),
            "cancellations_clean": sinks.write_table(self.cancellations_clean,
                                                     f"{base}/interim/cancellations_clean"),
            "pricing_clean": sinks.write_table(self.pricing_clean, f"{base}/interim/seasonal_pricing_clean"),
            "fact_bookings_enriched": sinks.write_fact(self.fact, f"{base}/processed/fact_bookings_enriched"),
        }
        dim = D.dim_segment(self.spark, self.cfg)
        counts["dim_segment"] = sinks.write_table(dim, f"{base}/load/dim_segment")
        sinks.publish(D.fact_typed(self.fact, dim, self.cfg), f"{base}/load/fact_bookings_enriched")
        counts["loaded_fact"] = sinks.read_published(self.spark, f"{base}/load/fact_bookings_enriched").count()
        return counts

    def publish(self, base: str) -> str:
        """The segmented fact and its rollup as one gated version under ``base``; later builds write only the months that changed.

        Readers take ``sinks.read_published(spark, base)`` and its table
        ``segment_daily``, which every view and metric accepts.  A day's
        occupancy is a column of the fact, so a booking changes only its own
        check-in month.
        """
        from staylens.sources import sinks

        return sinks.publish(self.fact_segmented, base, derived={"segment_daily": (V.segment_daily, "date")})


_PIPELINES: dict[tuple[str, str, str], Pipeline] = {}


def pipeline(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT_CONFIG) -> Pipeline:
    """The session's pipeline for ``sf_dir`` (built lazily, reused by every query)."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir.rstrip("/"), repr(cfg))
    p = _PIPELINES.get(key)
    if p is None or p.spark is not spark:
        p = Pipeline(spark, sf_dir.rstrip("/"), cfg)
        _PIPELINES[key] = p
    return p
