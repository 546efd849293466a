"""All registered corridor queries: importing their modules registers them."""

from fieldsift import (  # noqa: F401
    evidence_queries,
    field_queries,
    habitat_queries,
    line_queries,
    occurrence_queries,
    plane_queries,
    polygon_queries,
    repair_queries,
    research_queries,
    road_queries,
    search_queries,
    source_queries,
    stream_queries,
)
from fieldsift.first_queries import ORACLES, QUERIES  # noqa: F401
