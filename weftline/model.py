"""Schemas (DDL) of the data model and the constants that operators share. Constants are fixed values."""

from __future__ import annotations

REMOTE_QUERYABLE = ("OPENDAP",)
LOCAL = ("local_file", "soft_links_container")
QUERYABLE = (*REMOTE_QUERYABLE, *LOCAL)
WHOLE_FILE = ("FTPServer", "HTTPServer", "GridFTP")
FILE_TYPES = (*WHOLE_FILE, *QUERYABLE)
CONTAINER = "soft_links_container"
FIXED_FREQUENCIES = ("fx", "clim")
#: Steps and unit words of frequencies.
FREQUENCY_STEP = {"subhr": 30, "3hr": 3, "6hr": 6, "day": 1, "mon": 1, "yr": 1}
FREQUENCY_UNIT = {"subhr": "minutes", "3hr": "hours", "6hr": "hours", "day": "days", "mon": "months", "yr": "years"}
#: Elements that one request may have, remote and local, at 32 bytes an element.
REMOTE_ELEMENTS = 450 * 1024 * 1024 // 32
LOCAL_ELEMENTS = 2048 * 1024 * 1024 // 32
FUZZY_ABSOLUTE = FUZZY_RELATIVE = 1e-5

CF = "struct<year: int, month: int, day: int, hour: int, minute: int, second: int, microsecond: int>"

CATALOG = "path string, path_id bigint, version bigint, file_type string, data_node string, checksum_type string, checksum string, tracking_id string"
FILE_TIMES = "path string, idx bigint, time_num double, units string, calendar string"
LINKS = "var string, time_num double, path_id bigint, idx bigint"
VALUES_DENSE = "time_num double, shape array<int>, value array<double>"
COORDS = "grid_id string, i int, j int, lat double, lon double, vertices array<struct<lat: double, lon: double>>"
AXIS_AUDIT = "file string, start string, end string, last string, steps bigint, instant boolean, calendar string, units string, control array<string>, bnds boolean, checksum string"
