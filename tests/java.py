"""Java texts with the mappings they hold, worked out by hand."""

# A mapper with a type of its own between its methods, and a class whose methods hold an anonymous class, a
# lambda and a text block.
FLEET = '''
package fleet;

@Mapper
interface TruckMapping {
    Plate plate(Truck truck);

    final class Options { boolean strict() { return true; } }

    @Mapping(target = "axles", expression = "java(count(truck))")
    @Mapping(target = "depot.name", source = "home")
    Card card(Truck truck, @Context Options options);

    default Card twice(Truck truck) { return card(truck, new Options()); }

    @Mappings({ @Mapping(target = "audit", ignore = true) })
    Log log(Trip trip);
}

abstract class TripTools {
    enum Mode { DAY, NIGHT; Mode other() { return DAY; } }

    void toSummary(Trip trip, Summary out) {
        Sorter sorter = new Sorter() {
            @Override public int compare(Stop a, Stop b) { if (a.same(b)) { return 0; } return 1; }
        };
        out.setDistance(trip.getDistance());
        stops.forEach(s -> { sorter.add(s); });
        out.setNote("""
            } a note; with { braces (
            """);
        out.driver = trip.getDriver();
        String road = trip.getRoad();
        out.setRoute(road);
    }

    int toll(Trip trip) { return trip.getToll(); }

    Leg transformLeg(Stop stop) { Leg leg = new Leg(); leg.setEnd(stop.getEnd()); return leg; }
}
'''

# (type, method, source type, target type, source field, target field, ignore, implicit)
FLEET_ROWS = [
    ("mapstruct", "plate", "Truck", "Plate", None, None, False, True),
    ("mapstruct", "card", "Truck", "Card", None, "axles", False, False),
    ("mapstruct", "card", "Truck", "Card", "home", "depot.name", False, False),
    ("mapstruct", "log", "Trip", "Log", None, "audit", True, False),
    ("pojo", "toSummary", "Trip", "Summary", "distance", "distance", False, False),
    ("pojo", "toSummary", "Trip", "Summary", "driver", "driver", False, False),
    ("pojo", "toSummary", "Trip", "Summary", "road", "route", False, False),
    ("pojo", "transformLeg", "Stop", "Leg", "end", "end", False, False),
]

NESTED = """
public class OrderMapper {
    private void mapOrder(Order src, final Target t) throws Exception {
        List<Note> notes = new ArrayList<>();
        String c = src.getRemark();
        c = src.getComment();
        Note n = new Note();
        n.setKind(NOTE_KIND);
        n.setText(c);
        n.setAt(src.getCreated());
        n.setRank("first, second; third");
        n.setOwner(new Person("a", 1));
        n.setDeep(src.getExtras().get(SPECIAL_KEY));
        n.setMixed(join(src));
        if (src.getExtras().get(OTHER_KEY) instanceof String other) {
            n.setOther(other);
        }
        notes.add(n);
        t.setNotes(notes);
        t.setLabel(c);
        t.code = src.code;
        Place p = new Place();
        p.setCity(src.getCity());
        t.setPlace(p);
    }
}
"""

# (source field, target field, target path)
NESTED_ROWS = [
    ("constant:NOTE_KIND", "notes[].kind", "t.notes[].kind"),
    ("comment", "notes[].text", "t.notes[].text"),
    ("created", "notes[].at", "t.notes[].at"),
    ("created", "at", "n.at"),
    ('"first, second; third"', "notes[].rank", "t.notes[].rank"),
    ("constant", "notes[].owner", "t.notes[].owner"),
    ("extras.specialKey", "notes[].deep", "t.notes[].deep"),
    ("unknown", "notes[].mixed", "t.notes[].mixed"),
    ("extras.otherKey", "notes[].other", "t.notes[].other"),
    ("comment", "label", "label"),
    ("code", "code", "code"),
    ("city", "place.city", "t.place.city"),
    ("city", "city", "p.city"),
]
