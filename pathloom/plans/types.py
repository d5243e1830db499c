"""Type names, how they match, and the optional document model."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Suffixes of a choice element's fields, in the order in which they are tried.
CHOICE_SUFFIXES = (
    "Boolean Integer Integer64 Decimal String Code Id Uri Url Canonical Base64Binary Instant Date DateTime Time Oid Uuid Markdown PositiveInt UnsignedInt "
    "Quantity CodeableConcept Coding Range Period Ratio RatioRange Identifier Reference Attachment HumanName Address ContactPoint "
    "Timing Signature Annotation SampledData Age Distance Duration Count Money MoneyQuantity SimpleQuantity "
    "Meta Dosage ContactDetail Contributor DataRequirement Expression ParameterDefinition RelatedArtifact TriggerDefinition UsageContext"
).split()
#: Fields in which an extension's value may stand, in order.
EXTENSION_VALUES = (
    "valueString valueBoolean valueInteger valueDecimal valueDate valueDateTime valueTime valueCode valueCoding valueCodeableConcept valueQuantity "
    "valueReference valueIdentifier valuePeriod valueRange valueRatio valueAttachment valueUri valueUrl valueCanonical"
).split()
#: Document type names (lower case) and the expression type that they are.
STABLE = {
    "boolean": "Boolean", "string": "String", "integer": "Integer", "decimal": "Decimal", "date": "Date", "datetime": "DateTime", "time": "Time", "instant": "DateTime",
    "uri": "String", "url": "String", "canonical": "String", "base64binary": "String", "code": "String", "id": "String", "markdown": "String", "oid": "String", "uuid": "String",
    "positiveint": "Integer", "unsignedint": "Integer", "integer64": "Integer", "quantity": "Quantity", "money": "Quantity",
}
#: Quantity profiles, used only without a model.
PROFILES = {"simplequantity": "Quantity", "age": "Quantity", "count": "Quantity", "distance": "Quantity", "duration": "Quantity"}
#: Resources that aren't domain resources.
PLAIN_RESOURCES = frozenset(["Bundle", "Binary", "Parameters"])
PRIMITIVES = frozenset(["Boolean", "Integer", "Decimal", "String", "Date", "DateTime", "Time", "Quantity", "Object"])
TEMPORAL = {"date": "Date", "datetime": "DateTime", "instant": "DateTime", "time": "Time"}
TEXTUAL = frozenset(["uri", "url", "canonical", "oid", "uuid", "id", "code", "markdown", "base64binary"])


@dataclass
class Model:
    """Metadata of a document model.  Paths are like Observation.value."""

    choice_types: dict[str, list[str]] = field(default_factory=dict)
    type_of: dict[str, str] = field(default_factory=dict)
    reference_targets: dict[str, list[str]] = field(default_factory=dict)
    parent_type: dict[str, str] = field(default_factory=dict)
    resolve_path: dict[str, str] = field(default_factory=dict)
    resources: set[str] = field(default_factory=set)

    def is_subtype(self, child: str, parent: str) -> bool:
        seen = set()
        while child and child not in seen:
            if child == parent:
                return True
            seen.add(child)
            child = self.parent_type.get(child, "")
        return False


def is_resource_name(name: str) -> bool:
    """Without a model every capitalised name but those of primitive types may be a resource."""
    return name[:1].isupper() and name not in PRIMITIVES


def bare(name: str) -> str:
    return name.removeprefix("System.").removeprefix("FHIR.")


def matches(actual: str, wanted: str, model: Model | None = None) -> bool:
    """Whether a value of type actual is of the wanted type."""
    wanted = bare(wanted)
    if actual.lower() == wanted.lower():
        return True
    if model:
        if model.is_subtype(actual, wanted):
            return True
    elif (wanted == "Resource" and is_resource_name(actual)) or (wanted == "DomainResource" and is_resource_name(actual) and actual not in PLAIN_RESOURCES):
        return True
    for names in (STABLE,) if model else (STABLE, PROFILES):
        if names.get(wanted.lower()) == actual or names.get(actual.lower(), "").lower() == wanted.lower():
            return True
    return False
