"""Spark-native analytics for catalogues of posts with photos and videos.

Every public function takes and returns DataFrames (or Columns).  Nothing in
here starts a session, collects data, or loops over rows on the driver; the only
driver-side values are page-sized results and the stop test of iterative jobs.
"""
