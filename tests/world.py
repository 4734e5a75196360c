"""A small world of equipment in several systems, with a model over it."""

NOW = 1_735_689_600  # 2025-01-01
DAY = 86_400


def _serials(lo, hi):
    return [f"KX-{n}" for n in range(lo, hi)]


BOUGHT, BOTH, OWN, OFFICE = [*_serials(5_000, 5_075), "KX-5333"], _serials(5_050, 5_075), _serials(8_000, 8_033), _serials(9_101, 9_110)
DEPTS = [f"D{n:02}" for n in range(1, 7)]
DEVICES, SCRAPPED = BOTH + OWN, BOTH[:2]
COVERED, LAPSED = BOTH[:18], BOTH[:7]

# What must come out, from the lists alone.
ALL = set(BOUGHT) | set(DEVICES) | set(OFFICE)
STATUS = {s: "scrapped" if s in SCRAPPED else "in_transit" if s in BOUGHT and s not in DEVICES else "in_service" if s in DEVICES else None for s in ALL}
STAGES = {stage: list(STATUS.values()).count(stage) for stage in ("in_service", "in_transit", "scrapped", None)}
IN_WARRANTY = set(COVERED) - set(LAPSED)


def tables(spark):
    def frame(data, schema):
        return spark.createDataFrame(data, schema)

    device = [(i, f"device {s}", s, DEPTS[i % 6] if i % 12 or i < 2 else None, "scrapped" if s in SCRAPPED else "in use") for i, s in enumerate(DEVICES)]
    return {
        "purchases": {"item": frame([(i, f"item {s[3:]}", s) for i, s in enumerate(BOUGHT)], "po_id int, item_name string, sn string")},
        "devices": {
            "device": frame(device, "dev_id int, name string, serial_no string, dept_id string, status string"),
            "department": frame([(d, f"dept {d}") for d in DEPTS], "dept_id string, dept_name string"),
            "assignment": frame([(1, "A-1", "KX-5060", "D04", NOW, None), (2, "A-2", "KX-5060", "D05", NOW - 70 * DAY, NOW)], "id int, asgn_no string, sn string, dept_id string, valid_from long, valid_to long"),
            "repair": frame([(1, "R-1", "KX-5055", NOW - DAY, None), (2, "R-2", "KX-5056", NOW - 12 * DAY, NOW - 11 * DAY)], "id int, repair_no string, serial_no string, started_at long, ended_at long"),
        },
        "assets": {
            "asset": frame([(i, f"asset {s}", s) for i, s in enumerate(BOTH + OFFICE)], "asset_id int, asset_name string, sn string"),
            "warranty": frame([(i, s, NOW + (-6 if s in LAPSED else 250) * DAY) for i, s in enumerate(COVERED)], "card_id int, sn string, expiry long"),
        },
    }


def _source(connection, table, fields, **more):
    words = fields.split()
    return {"connection": connection, "table": table, "fields": dict(zip(words[::2], words[1::2]))} | more


MODEL = {
    "object_types": {
        "equipment": {
            "kind": "thing", "identity": "serial_no",
            "properties": {
                "name": {"type": "string"}, "serial_no": {"type": "string"}, "dept": {"type": "string"}, "mark": {"type": "enum"},
                "status": {"type": "enum", "values": ["in_transit", {"value": "in_service"}, "scrapped"], "derived": [
                    {"when": {"device": {"mark": "scrapped"}}, "value": "scrapped"}, {"when": {"purchase": True, "device": False}, "value": "in_transit"}, {"when": {"device": True}, "value": "in_service"}]},
                "in_warranty": {"type": "boolean", "derived": {"$link": {"covered_by": {"expiry": {"gte": "now/d"}}}}},
                "movable": {"type": "boolean", "derived": {"status": "in_service", "in_warranty": True}},
            },
            "sources": {
                "purchase": _source("purchases", "item", "name item_name serial_no sn"),
                "device": _source("devices", "device", "name name serial_no serial_no dept dept_id mark status"),
                "asset": _source("assets", "asset", "name asset_name serial_no sn"),
            },
            "axioms": {"one_mark": {"type": "mutex", "property": "mark"}},
            "actions": {
                "convert": {"pre": {"status": "in_transit", "$link": {"converted": False}}, "effect": [{"link": "converted"}, {"create": {"object": "card", "properties": {"serial_no": {"from": "identity"}, "expiry": "now+1y"}}}]},
                "transfer": {
                    "pre": {"status": "in_service", "dept": {"ne": {"property": "dept", "from": "request"}}, "$request": {"dept": {"object": "department"}}},
                    "effect": [{"update": {"object": "equipment", "identity": {"from": "identity"}, "properties": {"dept": {"from": "request"}}}}],
                    "inform": [{"object": "event", "to": ["desk"], "properties": {"what": {"from": "identity"}, "act": {"from": "action"}}}],
                },
                "remove": {"pre": {"$exists": True}, "effect": [{"delete": {"object": "equipment", "identity": {"from": "identity"}}}]},
                "close_repairs": {"effect": [{"update": {"object": "repair", "filter": {"serial_no": {"from": "identity"}, "ended_at": None}, "properties": {"ended_at": "now"}}}]},
                "muddle": {"effect": [{"update": {"object": "equipment", "identity": {"from": "identity"}, "properties": {"mark": m}}} for m in ("x", "y")]},
            },
        },
        "department": {"kind": "thing", "identity": "dept_id", "properties": {"dept_id": {"type": "string"}, "dept_name": {"type": "string"}}, "sources": {"base": _source("devices", "department", "dept_id dept_id dept_name dept_name")}},
        "assignment": {"kind": "event", "identity": "asgn_no", "properties": {"asgn_no": {"type": "string"}, "serial_no": {"type": "string"}, "dept_id": {"type": "string"}, "valid_from": {"type": "date"}, "valid_to": {"type": "date"}},
                       "sources": {"base": _source("devices", "assignment", "asgn_no asgn_no serial_no sn dept_id dept_id valid_from valid_from valid_to valid_to")}},
        "repair": {"kind": "event", "identity": "repair_no", "properties": {"repair_no": {"type": "string"}, "serial_no": {"type": "string"}, "started_at": {"type": "date"}, "ended_at": {"type": "date"}},
                   "sources": {"base": _source("devices", "repair", "repair_no repair_no serial_no serial_no started_at started_at ended_at ended_at")}},
        "card": {"kind": "thing", "identity": "serial_no", "properties": {"serial_no": {"type": "string"}, "expiry": {"type": "date"}}, "sources": {"base": _source("assets", "warranty", "serial_no sn expiry expiry")}},
        "event": {"kind": "event", "identity": "event_id", "properties": {"event_id": {"type": "string"}, "what": {"type": "string"}, "act": {"type": "string"}}},
    },
    "link_types": {
        "converted": {"from": "equipment", "to": "equipment", "inverse": "converted_from", "transition": {"property": "status", "from": "in_transit", "to": "in_service"}},
        "belongs_to": {"from": "equipment", "to": "department", "inverse": "has_equipment", "match": [{"from": "dept", "to": "dept_id"}]},
        "of_equipment": {"from": "assignment", "to": "equipment", "inverse": "assignments", "match": [{"from": "serial_no", "to": "serial_no"}]},
        "of_department": {"from": "assignment", "to": "department", "inverse": "has_assignments", "match": [{"from": "dept_id", "to": "dept_id"}]},
        "covers": {"from": "card", "to": "equipment", "inverse": "covered_by", "match": [{"from": "serial_no", "to": "serial_no"}]},
        "on_equipment": {"from": "repair", "to": "equipment", "inverse": "under_repair", "match": [{"from": "serial_no", "to": "serial_no"}]},
    },
    "outlets": {"desk": {"connection": "mail"}},
}


def engine(spark, model=None):
    from tessera.plans.engine import Engine
    from tessera.sources.catalog import frames

    made = Engine(spark, model or MODEL, clock=lambda: NOW)
    for name, held in tables(spark).items():
        made.sources.register(name, frames(held))
    return made
