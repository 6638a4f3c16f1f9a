"""Object lookup: one row for each uuid, merged from everything the log says about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import materialize
from ..functions.records import field, first_truthy, record_body, record_type, unwrap, unwrap_uuid

#: Record types that describe objects, and type names by role in order of priority.
KEPT_TYPES = ("Subject", "FileObject", "NetFlowObject", "RegistryKeyObject", "Host", "Principal")
ROLES = ("PROCESS", "FILE", "SOCKET", "EXECUTABLE")
ECAR_ROLES = {"PROCESS": "PROCESS", "THREAD": "PROCESS", "FILE": "FILE", "MODULE": "FILE", "REGISTRY": "FILE", "FLOW": "SOCKET"}


def role_of_type(kind: Column) -> Column:
    """Role of a CDM subtype or eCAR object type; null for those that have none."""
    cdm = F.when(kind.startswith("SUBJECT_"), "PROCESS").when(kind.startswith("FILE_OBJECT_UNIX_SOCKET") | (kind == "NetFlowObject"), "SOCKET")
    cdm = cdm.when(kind.startswith("FILE_OBJECT_") | (kind == "RegistryKeyObject"), "FILE")
    for name, role in ECAR_ROLES.items():
        cdm = cdm.when(kind == name, role)
    return cdm


def resolve_role(roles: Column) -> tuple[Column, Column]:
    """A-05: the role by priority, and whether several were seen; ``roles`` is a set."""
    best = F.lit(None).cast("string")
    for role in reversed(ROLES):
        best = F.when(F.array_contains(roles, role), role).otherwise(best)
    return best, F.size(roles) > 1


def cdm_mentions(lines: DataFrame, order: list[str]) -> DataFrame:
    """A.4: what each object record says, with the line's order; other records go (P-02)."""
    from ..functions.records import datum

    rows = lines.withColumn("_json", datum(F.col("value"))).withColumn("_type", record_type(F.col("_json")))
    rows = rows.where(F.col("_type").isin(*[t for t in KEPT_TYPES if t not in ("Host", "Principal")])).withColumn("_r", record_body(F.col("_json")))
    r, kind = F.col("_r"), F.col("_type")
    props = "baseObject.properties.map"
    path = F.when(kind == "Subject", unwrap(r, "cmdLine", "string")).when(kind == "FileObject", first_truthy(field(r, f"{props}.path"), field(r, f"{props}.filename")))
    path = path.when(kind == "NetFlowObject", unwrap(r, "localAddress", "string")).when(kind == "RegistryKeyObject", first_truthy(unwrap(r, "key", "string"), field(r, f"{props}.key")))
    subtype = F.when(kind.isin("Subject", "FileObject"), unwrap(r, "type", "string")).otherwise(kind)
    return rows.select(
        *order, F.upper(field(r, "uuid")).alias("uuid"), subtype.alias("type"), path.alias("path"),
        F.when(kind == "NetFlowObject", unwrap(r, "remoteAddress", "string")).alias("ip"),
        F.when(kind == "NetFlowObject", unwrap(r, "remotePort", "int").cast("int")).alias("port"),
        F.when(kind == "Subject", unwrap(r, "cmdLine", "string")).alias("cmdline"),
        F.when(kind == "Subject", unwrap(r, "cid", "int").cast("int")).alias("pid"),
        F.when(kind == "Subject", unwrap_uuid(r, "parentSubject")).alias("parent_uuid"),
        F.when(kind.isin("Subject", "FileObject"), unwrap_uuid(r, "localPrincipal")).alias("principal_uuid"),
    ).where("uuid is not null and uuid <> ''")


def ecar_mentions(lines: DataFrame, order: list[str]) -> DataFrame:
    """A.4 for eCAR: the object of each line, and its actor as a process."""
    v, p = F.col("value"), "properties."
    kind = field(v, "object")
    obj = F.struct(
        F.upper(field(v, "objectID")).alias("uuid"), kind.alias("type"),
        F.when(kind.isin("FILE", "MODULE"), field(v, p + "file_path")).when(kind == "REGISTRY", first_truthy(field(v, p + "key"), field(v, p + "value"))).alias("path"),
        F.when(kind == "FLOW", first_truthy(field(v, p + "dest_ip"), field(v, p + "src_ip"))).alias("ip"),
        F.when(kind == "FLOW", field(v, p + "dest_port").cast("int")).alias("port"),
        F.when(kind == "PROCESS", field(v, p + "image_path")).alias("cmdline"),
        F.when(kind == "PROCESS", field(v, "pid").cast("int")).alias("pid"),
    )
    none = lambda t: F.lit(None).cast(t)
    actor = F.struct(F.upper(field(v, "actorID")).alias("uuid"), F.lit("PROCESS").alias("type"), none("string").alias("path"), none("string").alias("ip"), none("int").alias("port"), none("string").alias("cmdline"), field(v, "pid").cast("int").alias("pid"))
    rows = lines.select(*order, F.explode(F.array(obj, actor)).alias("m")).select(*order, "m.*")
    return rows.withColumns({"parent_uuid": none("string"), "principal_uuid": none("string")}).where("uuid is not null and uuid <> ''")


def object_lookup(mentions: DataFrame, order: list[str], role: Column | None = None) -> DataFrame:
    """A-03, A-04: one row a uuid: all types, the first value that isn't empty or zero, the last parent and principal.

    A single hash aggregate with map-side combination; what is only ever empty
    or zero stays so. Objects without a role go (A-05).
    """
    at = F.struct(*order)
    good = lambda c: (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0")
    first = lambda c: F.coalesce(F.min_by(c, F.when(good(c), at)), F.max_by(c, F.when(F.col(c).isNotNull(), at)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    rows = mentions.withColumn("_role", role_of_type(F.col("type")) if role is None else role)
    rows = rows.groupBy("uuid").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types_raw"), F.collect_set("_role").alias("_roles"),
        *[first(c).alias(c) for c in ("path", "ip", "port", "cmdline", "pid")], *[last(c).alias(c) for c in ("parent_uuid", "principal_uuid")],
    )
    best, several = resolve_role(F.col("_roles"))
    return rows.withColumns({"role": best, "ambiguous": several}).where("role is not null").drop("_roles")


def role_statistics(mentions: DataFrame, order: list[str]) -> DataFrame:
    """A-06: objects by role, ambiguous ones, and those without a role."""
    rows = mentions.withColumn("_role", role_of_type(F.col("type"))).groupBy("uuid").agg(F.collect_set("_role").alias("r"))
    best, several = resolve_role(F.col("r"))
    return rows.select(F.coalesce(best, F.lit("none")).alias("role"), several.alias("ambiguous")).groupBy("role").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("n_ambiguous"))


def present(uuids: DataFrame, lookup: DataFrame) -> DataFrame:
    """J-02: uuids that the lookup has, spelled as asked."""
    return uuids.withColumn("_u", F.upper("uuid")).join(lookup.select(F.col("uuid").alias("_u")), "_u", "left_semi").drop("_u")


def resolve_chain(nodes: DataFrame, node: str, parent: str, stop: Column, depth: int = 10) -> DataFrame:
    """J-03: follow parents until ``stop``, a missing parent, a loop to itself, or ``depth`` hops.

    ``nodes`` has one row a node. Returns ``node, resolved, hops``. A parent
    outside ``nodes`` is still the result. Jumps double: one of two hops is two
    of one, and so on, each written once; those whose sizes add up to ``depth``
    follow each other. Ten hops are four joins.
    """
    edges = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"), F.coalesce(stop, F.lit(False)).alias("_stop"))
    move = (~F.col("_stop")) & F.col("_p").isNotNull() & (F.col("_p") != F.col("_n"))
    jump = edges.select(F.col("_n").alias("node"), F.when(move, F.col("_p")).otherwise(F.col("_n")).alias("at"), F.when(move, 1).otherwise(0).alias("hops"))

    def after(first: DataFrame, second: DataFrame) -> DataFrame:
        step = second.select(F.col("node").alias("_n"), F.col("at").alias("_a"), F.col("hops").alias("_h"))
        rows = first.join(step, F.col("at") == F.col("_n"), "left")
        return rows.select("node", F.coalesce("_a", "at").alias("at"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))

    done, size = None, 1
    while True:
        if depth & size:
            done = jump if done is None else after(done, jump)
        size *= 2
        if size > depth:
            break
        jump = materialize(after(jump, jump), "jumps")
    return done.select("node", F.col("at").alias("resolved"), F.col("hops").cast("long").alias("hops"))


def process_map(lookup: DataFrame, depth: int = 10) -> DataFrame:
    """Threads and units to the process that they belong to."""
    return resolve_chain(lookup.where("role = 'PROCESS'"), "uuid", "parent_uuid", F.col("types_raw").contains("SUBJECT_PROCESS"), depth)


def host_metadata(lines: DataFrame, order: list[str]) -> DataFrame:
    """Host records: name, kind, system and interfaces of each, the last line's where they repeat."""
    from ..functions.records import datum

    rows = lines.withColumn("_json", datum(F.col("value"))).where(record_type(F.col("_json")) == "Host").withColumn("_r", record_body(F.col("_json")))
    r = F.col("_r")
    listed = F.from_json(F.coalesce(field(r, "interfaces.array"), field(r, "interfaces")), "array<struct<name:string,macAddress:string,ipAddresses:string>>")
    address = lambda i: F.coalesce(F.from_json(F.get_json_object(i["ipAddresses"], "$.array"), "array<string>"), F.from_json(i["ipAddresses"], "array<string>"))
    faces = F.transform(listed, lambda i: F.struct(i["name"].alias("name"), i["macAddress"].alias("macAddress"), address(i).alias("ipAddresses")))
    rows = rows.select(*order, F.upper(field(r, "uuid")).alias("uuid"), field(r, "hostName").alias("host_name"), field(r, "hostType").alias("host_type"), unwrap(r, "osDetails", "string").alias("os_details"), faces.alias("interfaces"))
    names = ["host_name", "host_type", "os_details", "interfaces"]
    return rows.groupBy("uuid").agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in names])


def principal_metadata(lines: DataFrame, order: list[str]) -> DataFrame:
    """Principal records: user id and name and groups of each."""
    from ..functions.records import datum

    rows = lines.withColumn("_json", datum(F.col("value"))).where(record_type(F.col("_json")) == "Principal").withColumn("_r", record_body(F.col("_json")))
    r = F.col("_r")
    groups = F.from_json(F.coalesce(field(r, "groupIds.array"), field(r, "groupIds")), "array<string>")
    rows = rows.select(*order, F.upper(field(r, "uuid")).alias("uuid"), unwrap(r, "userId", "string").alias("user_id"), unwrap(r, "username", "string").alias("username"), groups.alias("group_ids"))
    return rows.groupBy("uuid").agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in ("user_id", "username", "group_ids")])
