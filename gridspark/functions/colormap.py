"""Colour maps: anchors, 256-entry tables and their DataFrame form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# RGB anchors of the published maps, evenly spaced on [0, 1].
VIRIDIS = [
    (0.267004, 0.004874, 0.329415), (0.282623, 0.140926, 0.457517), (0.253935, 0.265254, 0.529983), (0.206756, 0.371758, 0.553117),
    (0.163625, 0.471133, 0.558148), (0.127568, 0.566949, 0.550556), (0.134692, 0.658636, 0.517649), (0.266941, 0.748751, 0.440573),
    (0.477504, 0.821444, 0.318195), (0.741388, 0.873449, 0.149561), (0.993248, 0.906157, 0.143936),
]
PLASMA = [
    (0.050383, 0.029803, 0.527975), (0.132381, 0.022258, 0.563250), (0.193374, 0.018354, 0.590330), (0.248032, 0.014439, 0.612868),
    (0.299855, 0.009561, 0.631624), (0.350150, 0.004382, 0.646298), (0.399411, 0.000859, 0.656133), (0.447714, 0.002080, 0.660240),
    (0.494877, 0.011990, 0.657865), (0.540570, 0.034950, 0.648640), (0.584391, 0.068579, 0.632812), (0.625987, 0.103312, 0.611305),
    (0.665129, 0.138566, 0.585582), (0.701769, 0.174005, 0.557296), (0.736019, 0.209439, 0.527908), (0.768090, 0.244817, 0.498465),
    (0.798216, 0.280197, 0.469538), (0.826588, 0.315714, 0.441316), (0.853319, 0.351553, 0.413734), (0.878423, 0.387932, 0.386600),
    (0.901807, 0.425087, 0.359688), (0.923287, 0.463251, 0.332801), (0.942598, 0.502639, 0.305816), (0.959424, 0.543431, 0.278701),
    (0.973416, 0.585761, 0.251540), (0.984199, 0.629718, 0.224595), (0.991365, 0.675355, 0.198453), (0.994474, 0.722691, 0.174381),
    (0.993033, 0.771720, 0.154808), (0.986509, 0.822401, 0.143557), (0.974443, 0.874622, 0.144061), (0.956808, 0.928152, 0.152409),
    (0.940015, 0.975158, 0.131326),
]
CIVIDIS = [
    (0.000000, 0.135112, 0.304751), (0.000000, 0.157932, 0.357521), (0.000000, 0.178802, 0.414764), (0.017852, 0.198528, 0.441248),
    (0.103401, 0.220406, 0.435790), (0.154261, 0.242475, 0.430120), (0.195057, 0.264372, 0.425924), (0.230871, 0.286134, 0.423498),
    (0.263738, 0.307831, 0.422789), (0.294669, 0.329531, 0.423716), (0.324250, 0.351289, 0.426250), (0.352892, 0.373153, 0.430226),
    (0.380830, 0.395164, 0.435653), (0.408226, 0.417357, 0.442570), (0.435168, 0.439763, 0.451134), (0.461616, 0.462405, 0.461969),
    (0.488697, 0.485318, 0.471008), (0.517920, 0.508454, 0.472707), (0.547840, 0.531895, 0.471704), (0.578236, 0.555673, 0.468724),
    (0.609105, 0.579816, 0.463638), (0.640352, 0.604354, 0.456791), (0.671991, 0.629316, 0.448018), (0.704037, 0.654731, 0.437147),
    (0.736488, 0.680629, 0.424028), (0.769353, 0.707035, 0.408516), (0.802667, 0.733978, 0.390153), (0.836429, 0.761483, 0.368747),
    (0.870717, 0.789572, 0.343333), (0.905589, 0.818257, 0.312889), (0.941147, 0.847530, 0.275815), (0.977780, 0.877281, 0.227954),
    (0.995737, 0.909344, 0.217772),
]
TURBO = [
    (0.189950, 0.071760, 0.232170), (0.225000, 0.163540, 0.450960), (0.251070, 0.252370, 0.633740), (0.268160, 0.338250, 0.780500),
    (0.276280, 0.421180, 0.891230), (0.275430, 0.501150, 0.965940), (0.258620, 0.579580, 0.998760), (0.213820, 0.658860, 0.979590),
    (0.158440, 0.735510, 0.923050), (0.111670, 0.805690, 0.845250), (0.092670, 0.865540, 0.762300), (0.120140, 0.911930, 0.686600),
    (0.196590, 0.949010, 0.594660), (0.305130, 0.976970, 0.489870), (0.427780, 0.994190, 0.385750), (0.546580, 0.999070, 0.295810),
    (0.643620, 0.989990, 0.233560), (0.725960, 0.964700, 0.206400), (0.804730, 0.924520, 0.204590), (0.875300, 0.872670, 0.215550),
    (0.933010, 0.812360, 0.226670), (0.973230, 0.746820, 0.225360), (0.993140, 0.674080, 0.203480), (0.995930, 0.587030, 0.168990),
    (0.983600, 0.492910, 0.128490), (0.958010, 0.399580, 0.088310), (0.921050, 0.314890, 0.054750), (0.874220, 0.245260, 0.032970),
    (0.816080, 0.184620, 0.018090), (0.746170, 0.130980, 0.008510), (0.664490, 0.084360, 0.004240), (0.571030, 0.044740, 0.005290),
    (0.479600, 0.015830, 0.010550),
]
COOLWARM = [
    (0.229806, 0.298718, 0.753683), (0.266381, 0.353304, 0.801637), (0.304174, 0.406945, 0.845263), (0.343278, 0.459354, 0.884122),
    (0.383662, 0.510183, 0.917831), (0.425199, 0.559058, 0.946061), (0.467678, 0.605591, 0.968546), (0.510824, 0.649397, 0.985079),
    (0.554312, 0.690097, 0.995516), (0.597777, 0.727330, 0.999777), (0.640828, 0.760752, 0.997846), (0.683056, 0.790043, 0.989768),
    (0.724041, 0.814910, 0.975651), (0.763363, 0.835092, 0.955658), (0.800601, 0.850358, 0.930008), (0.835345, 0.860514, 0.898970),
    (0.867428, 0.864377, 0.862602), (0.899543, 0.847500, 0.817789), (0.925563, 0.825517, 0.771136), (0.945540, 0.798606, 0.723105),
    (0.959518, 0.766973, 0.674145), (0.967544, 0.730850, 0.624685), (0.969683, 0.690484, 0.575138), (0.966017, 0.646130, 0.525890),
    (0.956653, 0.598034, 0.477302), (0.941728, 0.546413, 0.429707), (0.921406, 0.491420, 0.383408), (0.895885, 0.433075, 0.338681),
    (0.865391, 0.371128, 0.295769), (0.830187, 0.304733, 0.254891), (0.790562, 0.231397, 0.216242), (0.746838, 0.140021, 0.179996),
    (0.705673, 0.015556, 0.150233),
]
# The eleven colours of the published diverging schemes, 0..255.
RDBU_11 = [(103, 0, 31), (178, 24, 43), (214, 96, 77), (244, 165, 130), (253, 219, 199), (247, 247, 247), (209, 229, 240), (146, 197, 222), (67, 147, 195), (33, 102, 172), (5, 48, 97)]
BRBG_11 = [(84, 48, 5), (140, 81, 10), (191, 129, 45), (223, 194, 125), (246, 232, 195), (245, 245, 245), (199, 234, 229), (128, 205, 193), (53, 151, 143), (1, 102, 94), (0, 60, 48)]


def resampled(colours: list[tuple], n: int = 33) -> list[tuple]:
    """n anchors of a piecewise linear scheme, read from its 256-step table and kept to six places."""
    out = []
    for k in range(n):
        at = min(int(k / (n - 1) * 256), 255) / 255 * (len(colours) - 1)
        i = min(int(at), len(colours) - 2)
        out.append(tuple(round((a + (b - a) * (at - i)) / 255, 6) for a, b in zip(colours[i], colours[i + 1], strict=True)))
    return out


@dataclass(frozen=True)
class Colormap:
    name: str
    label: str
    kind: str
    anchors: tuple

    def entry(self, k: int) -> tuple[int, int, int]:
        """RGB of table place k of 256."""
        at = min(k, 255) / 255 * (len(self.anchors) - 1)
        i = min(int(at), len(self.anchors) - 2)
        return tuple(int(min(max((a + (b - a) * (at - i)) * 255, 0.0), 255.0) + 0.5) for a, b in zip(self.anchors[i], self.anchors[i + 1], strict=True))

    def lut(self, reverse: bool = False) -> list[tuple[int, int, int]]:
        out = [self.entry(k) for k in range(256)]
        return out[::-1] if reverse else out

    def css_stops(self, n: int, reverse: bool = False) -> list[str]:
        t = self.lut(reverse)
        return ["#%02x%02x%02x" % t[int(i / (n - 1) * 255 + 0.5) if n > 1 else 0] for i in range(n)]


REGISTRY = {
    c.name: c
    for c in (
        Colormap("viridis", "Viridis", "sequential", tuple(VIRIDIS)),
        Colormap("plasma", "Plasma", "sequential", tuple(PLASMA)),
        Colormap("cividis", "Cividis", "sequential", tuple(CIVIDIS)),
        Colormap("turbo", "Turbo", "sequential", tuple(TURBO)),
        Colormap("grayscale", "Grayscale", "sequential", ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))),
        Colormap("rdbu", "Red–Blue", "diverging", tuple(resampled(RDBU_11))),
        Colormap("brbg", "Brown–Teal", "diverging", tuple(resampled(BRBG_11))),
        Colormap("coolwarm", "Cool–Warm", "diverging", tuple(COOLWARM)),
    )
}


def get(name: str) -> Colormap:
    if name not in REGISTRY:
        raise ValueError(f"unknown colormap {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]


def frame(spark: SparkSession, *names: str, reverse: bool = False) -> DataFrame:
    """(name, idx, r, g, b): 256 rows per map, small enough to broadcast."""
    rows = [(n, k, *rgb) for n in (names or REGISTRY) for k, rgb in enumerate(get(n).lut(reverse))]
    return spark.createDataFrame(rows, "name string, idx int, r int, g int, b int")
