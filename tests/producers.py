"""Services that tests pull from: a query is a file that says how many records there are by now; one beside it says that the service is down."""

from __future__ import annotations

import os

from tidepool.sources.paged import DatasetRows, Replayed


class Counted:
    def available(self, query):
        with open(query) as f:
            return int(f.read())

    def read(self, query, start, end):
        if os.path.exists(f"{query}.down") and end > 30:
            raise OSError("the service is down")
        for i in range(start, end):
            with open(f"{query}.reads", "a") as f:
                f.write(f"{i}\n")
            yield {"id": f"{os.path.basename(query)}{i}", "value": i}


class Lossy(Counted):
    def read(self, query, start, end):
        return super().read(query, start, min(end, 15))


class FromTheBeginning(Replayed):
    def available(self, query):
        return 25

    def records(self, query):
        for i in range(20 if query.endswith("short") else 25):
            yield {"id": i}


class Reviews(Counted):
    def read(self, query, start, end):
        for r in super().read(query, start, end):
            i = r["value"]
            yield {"asin": f"A{i}", "user_id": f"U{i}", "rating": 1 + i % 5, "text": "fine", "timestamp": 1588687728923, "extra": {"of": "the service"}}


class Served(DatasetRows):
    """A dataset of 250 rows; one called short loses its rows from 120 on."""

    def fetch(self, url, params, headers):
        assert url == self.URL and params["length"] <= 100 and params["split"] == "train"
        n = 120 if params["dataset"] == "short" else 250
        at = range(params["offset"], min(params["offset"] + params["length"], n))
        return {"num_rows_total": 250, "rows": [{"row_idx": i, "row": {"value": i}} for i in at]}
