"""The registered queries, by area."""

from civiclake.plans.catalogs import CATALOGS
from civiclake.plans.claims import CHECKS
from civiclake.plans.landing import LANDING
from civiclake.plans.places import PLACES
from civiclake.plans.profiling import PROFILING
from civiclake.plans.querying import QUERYING
from civiclake.plans.registries import REGISTRIES
from civiclake.plans.sql import SQL

SUITES = [SQL, PROFILING, REGISTRIES, CATALOGS, QUERYING, CHECKS, PLACES, LANDING]
