r"""Documents and expressions that both evaluators must agree on."""

P = '{"resourceType":"Patient","id":"123","active":true,"name":[{"use":"official","family":"Doe","given":["John","James"]},{"use":"nickname","given":["Johnny"]}],"birthDate":"1990-01-15","address":[{"city":"Boston","state":"MA"}],"extension":[{"url":"http://a","valueString":"Boston"},{"url":"http://b","valueCode":"white"}]}'
PS = "resourceType STRING, id STRING, active BOOLEAN, birthDate DATE, name ARRAY<STRUCT<use:STRING,family:STRING,given:ARRAY<STRING>>>, address ARRAY<STRUCT<city:STRING,state:STRING>>, extension ARRAY<STRUCT<url:STRING,valueString:STRING,valueCode:STRING>>"
S = '{"value":42,"decimal":3.14,"text":"hello","active":true,"items":[1,2,3,4,5],"words":["b","a","b"],"neg":-3.5}'
SS = "value BIGINT, decimal DECIMAL(10,2), text STRING, active BOOLEAN, items ARRAY<BIGINT>, words ARRAY<STRING>, neg DECIMAL(5,1)"
O = '{"resourceType":"Observation","id":"obs1","status":"final","valueQuantity":{"value":72,"unit":"beats/min","code":"/min"},"subject":{"reference":"Patient/7"}}'
OS = "resourceType STRING, id STRING, status STRING, valueQuantity STRUCT<value:DECIMAL(38,18),unit:STRING,code:STRING>, subject STRUCT<reference:STRING>"
CASES = {
    'P':(P,PS,r"""Patient.name.where(use = 'official').family
Patient.name.given.count()
Patient.name[10].family
Patient.name[0].given
name.given.join(', ')
name.given.first()
name.given.last()
name.given.tail()
name.given.skip(1).take(1)
name.exists(use='official') and active
name.all(use.exists())
birthDate.year()
birthDate.month()
birthDate + 1 month
birthDate > @1990-01-01
birthDate > @1989
birthDate = @1990-01-15
Resource.id
Patient.is(Resource)
name.select(given.first())
name.select(given)
name.where($index = 1).use
name.family.empty()
extension('http://a').valueString
hasExtension('http://b')
getExtensionValue('http://a')
name.given.distinct().count()
name.given | name.use
id.toInteger() + 1
name.given.where($this.startsWith('J')).count()
iif(active, 'y', 'n')
name.use.subsetOf('official' | 'nickname' | 'x')
name.given.exclude('John')
name.given.intersect('John' | 'Johnny')
name.given contains 'James'
'James' in name.given
address.city = 'Boston'
active.not()
%resource.id & '-' & %context.address.city
name.first().given.join('+')
name.given.single()
name.use ~ 'x'
name.select($index)"""),
    'S': (S,SS,r"""2 + 3 * 4
7 / 2
7 div 2
-7 mod 2
1 / 3
decimal * 2
decimal + value
value / decimal
items.sum()
items.avg()
items.min()
items.max()
items.aggregate($this + $total, 0)
items.aggregate(iif($total.empty(), $this, $total * $this))
items.where($this > 2).select($this * 2)
items.select($this + $index)
(1|2|3) contains 2
(1|1).count()
items.combine(6|7).count()
items.union(5|6)
10 'mg' = 0.01 'g'
60 'min' = 1 'h'
1 'kg' = 1 'm'
10 'kg' > 5 'mg'
1 year = 12 months
'hello   world' ~ 'hello world'
'Hello'.lower().startsWith('hel')
'hello'.indexOf('l')
'hello'.substring(1, 2)
'hello'.substring(1)
'hello'.replace('l', 'L')
'abc'.replace('', '-')
'abc'.toChars()
'a,b,,c'.split(',')
'  x '.trim()
'hello'.length()
'héé'.length()
'hello'.matches('l+')
'hello'.replaceMatches('l(.)', '<$1>')
text.upper()
16.sqrt().power(2)
neg.abs()
neg.ceiling()
neg.floor()
neg.truncate()
decimal.round(1)
3.5.round()
100.log(10)
1.ln()
'true'.toBoolean()
'42'.toInteger()
' 42 '.toInteger()
'3.14'.toDecimal()
decimal.toString()
value.toString()
'5 mg'.toQuantity() = 5 'mg'
'abc'.convertsToInteger()
'1.5'.convertsToDecimal()
{}.convertsToBoolean()
value is Integer
decimal is Decimal
text is string
text as String
true and {}
false and {}
true or {}
true xor false
true implies 'x'
{} implies true
1 = 1.0
1 != 2
1 ~ 1.0
{} ~ {}
'a' & 1
@2024-01-31 + 1 month
@2024-02.highBoundary()
@2024.lowBoundary()
1.0.lowBoundary()
1.0.highBoundary()
@T12:30.highBoundary()
@2024-01-01 < @2024-01-02
@2024-01 < @2024-02
@2024-05-01.day()
@T10:20:30.minute()
items.distinct().isDistinct()
words.distinct()
words.isDistinct()
items.subsetOf(items)
words.count() > 2 and items.exists()
items.first() = 1
items[1]
items.tail().count()
items.skip(10).empty()
items.all($this > 0)
items.exists($this > 4)
(items.select($this > 0)).allTrue()
hasValue()
value.hasValue()
'2024-01-01'.toDate() = @2024-01-01
trace('x').value
5 'mg' + 3 'mg' = 8 'mg'
'x'.toQuantity().empty()
1.convertsToQuantity('kg')
'5 kg'.convertsToQuantity('g')"""),
    'O': (O,OS,r"""Observation.value.unit
value > 70 'beats/min'
value is Quantity
value.ofType(Quantity).value
subject.getReferenceKey()
subject.getReferenceKey('id')
status in ('final' | 'amended')
memberOf('x')
value.value / 2"""),
}
