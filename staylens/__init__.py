"""staylens: hotel-demand analytics as Spark DataFrame jobs.

Crawler snapshots of destination searches and hotel views are batched into
observation intervals, aggregated per hotel / destination / check-in date,
joined with bookings and price-parity feeds into a funnel, scored, ranked
and compared across equally covered windows and ISO weeks.

Every operator is a DataFrame -> DataFrame function (usable with
``DataFrame.transform``); nothing is collected to the driver except
schema checks and size checks on small dimension tables.
"""

from staylens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
