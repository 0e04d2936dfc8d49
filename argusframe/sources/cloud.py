"""Cloud audit logs into one event shape: provider, service, action, principal, resource, source_ip, user_agent, error_code, region, event_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AWS = "Records array<struct<eventID:string,eventSource:string,eventName:string,awsRegion:string,sourceIPAddress:string,userAgent:string,errorCode:string,userIdentity:struct<arn:string,principalId:string,userName:string>,resources:array<struct<ARN:string>>>>"
GCP = "insertId string, resource struct<labels:map<string,string>>, protoPayload struct<serviceName:string,methodName:string,resourceName:string,authenticationInfo:struct<principalEmail:string>,requestMetadata:struct<callerIp:string,callerSuppliedUserAgent:string>,status:struct<code:int,message:string>>"
AZURE = "records array<struct<id:string,correlationId:string,operationName:string,caller:string,callerIpAddress:string,level:string,resourceId:string,resultType:string,category:string,claims:map<string,string>>>"


def some(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def shape(provider: str, **fields: Column) -> list[Column]:
    names = ["service", "action", "principal", "resource", "source_ip", "user_agent", "error_code", "region", "event_id"]
    return [F.lit(provider).alias("provider"), *[some(fields.get(n, F.lit(""))).alias(n) for n in names]]


def cloudtrail(raw: DataFrame, column: str = "value") -> DataFrame:
    r = raw.select(F.explode(F.from_json(column, AWS)["Records"]).alias("r")).select("r.*")
    c, who = F.col, F.col("userIdentity")
    return r.select(*shape("aws", service=F.regexp_replace(c("eventSource"), r"\.amazonaws\.com\z", ""), action=c("eventName"), principal=some(who["arn"], who["principalId"], who["userName"]), resource=F.get(c("resources"), F.lit(0))["ARN"], source_ip=c("sourceIPAddress"), user_agent=c("userAgent"), error_code=c("errorCode"), region=c("awsRegion"), event_id=c("eventID")))


def gcp_audit(raw: DataFrame, column: str = "value") -> DataFrame:
    r = raw.select(F.from_json(column, GCP).alias("r")).where("r.protoPayload is not null").select("r.*")
    p, labels = F.col("protoPayload"), F.col("resource.labels")
    code = F.when(p["status"]["code"] != 0, some(p["status"]["message"], F.concat(F.lit("CODE_"), p["status"]["code"].cast("string"))))
    return r.select(*shape("gcp", service=p["serviceName"], action=p["methodName"], principal=p["authenticationInfo"]["principalEmail"], resource=p["resourceName"], source_ip=p["requestMetadata"]["callerIp"], user_agent=p["requestMetadata"]["callerSuppliedUserAgent"], error_code=code, region=some(*[F.try_element_at(labels, F.lit(k)) for k in ("location", "zone", "region")]), event_id=F.col("insertId")))


def azure_activity(raw: DataFrame, column: str = "value") -> DataFrame:
    r = raw.select(F.explode(F.from_json(column, AZURE)["records"]).alias("r")).select("r.*")
    c, claim = F.col, lambda k: F.try_element_at(F.col("claims"), F.lit(k))
    group = F.regexp_extract(c("resourceId"), r"(?i)/resourceGroups/([^/]+)", 1)
    return r.select(*shape("azure", service=F.split(c("operationName"), "/")[0], action=c("operationName"), principal=some(c("caller"), claim("upn"), claim("appid")), resource=c("resourceId"), source_ip=c("callerIpAddress"), error_code=F.when(c("level").isin("Error", "Critical"), c("resultType")), region=group, event_id=some(c("correlationId"), c("id"))))


def indicator_lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """(kind, value) of lines ``value # comment``; a slash makes a network, else a domain; private networks are left out."""
    value = F.trim(F.substring_index(column, "#", 1))
    rows = raw.select(value.alias("value")).where("value <> ''")
    private = F.col("value").rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    return rows.select(F.when(F.contains("value", F.lit("/")), "cidr").otherwise("domain").alias("kind"), F.lower("value").alias("value")).where(~((F.col("kind") == "cidr") & private))
