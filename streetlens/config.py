"""Every constant of the analysis, in one frozen record."""

from __future__ import annotations

import dataclasses
import math


@dataclasses.dataclass(frozen=True)
class Config:
    """Fixed values of the analysis; replace() gives variants."""

    n_split: int = 4
    crop_hfov_deg: float = 90.0
    crop_width: int = 256
    crop_height: int = 256
    min_blocker_px: int = 200
    overlay_alpha: float = 0.55
    vehicle_bgr: tuple[int, int, int] = (0, 140, 255)
    default_bgr: tuple[int, int, int] = (128, 128, 128)
    depth_scale: float = 50.0
    disparity_eps: float = 1e-8
    grid_res: float = 0.5
    max_range: float = 60.0
    half_width: float = 30.0
    cam_height: float = 2.5
    hood_frac: float = 0.25
    center_half_angle_deg: float = 15.0
    min_vehicle_px: int = 50
    include_vehicles: bool = True
    show_road: bool = True
    occluder_from_depth: bool = True
    depth_r2_min: float = 0.5
    haz_gap: float = 3.0
    haz_r: float = 40.0
    subsample: int = 2
    smooth_window: int = 5
    connect_thresh: float = 4.0
    horizon_eps: float = 1e-3
    calibration_min_px: int = 300
    calibration_v_frac: float = 0.5
    calibration_horizon_px: float = 2.0
    min_inverse_depth: float = 1e-3
    n_rays: int = 720
    ray_step_frac: float = 0.7
    front_cone_deg: float = 10.0
    friction: float = 0.7
    gravity: float = 9.8
    reaction_s: float = 1.0
    speed_kmh: float = 50.0
    v_heavy: float = 0.15
    min_l_vis: float = 0.1
    safe_below: float = 1.0
    caution_below: float = 1.8
    sample_n: int = 10
    depth_sample_seed: int = 42
    bev_sample_seed: int = 41
    comparison_n: int = 6

    def replace(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)

    @property
    def canvas(self) -> int:
        """Cells along a side of the merged grid."""
        return int(self.max_range * 2 / self.grid_res)

    @property
    def center(self) -> tuple[int, int]:
        return self.canvas // 2, self.canvas // 2

    @property
    def single_grid(self) -> tuple[int, int]:
        """Columns and rows of the single-view grid."""
        return int(self.half_width * 2 / self.grid_res), int(self.max_range / self.grid_res)

    @property
    def single_origin(self) -> tuple[int, int]:
        width, height = self.single_grid
        return width // 2, height - 1

    @property
    def hood_row(self) -> int:
        """The first image row that the own vehicle's hood may cover."""
        return int(self.crop_height * (1 - self.hood_frac)) if self.hood_frac > 0 else self.crop_height

    @property
    def ray_step(self) -> float:
        return self.grid_res * self.ray_step_frac

    @property
    def ray_steps(self) -> int:
        return int(self.max_range / self.ray_step)

    @property
    def disk_area(self) -> float:
        return math.pi * self.max_range**2

    @property
    def rectangle_area(self) -> float:
        return self.max_range * self.half_width * 2


DEFAULT = Config()

#: Index, name and yaw in degrees of the four directions.
DIRECTIONS = ((0, "left", -90.0), (1, "front", 0.0), (2, "right", 90.0), (3, "back", 180.0))
#: Layers from the bottom up, and their colours (RGB).
LAYER_RGB = (
    ("sidewalk", (200, 180, 140)),
    ("road", (90, 90, 90)),
    ("other", (100, 200, 100)),
    ("occ", (220, 80, 80)),
    ("veh_center", (120, 170, 255)),
    ("veh_side", (255, 140, 0)),
)
#: Colours of no data, shadow, the hazard panel's shadow and depth-calibrated cells (RGB).
NO_DATA_RGB, SHADOW_RGB, HAZARD_RGB, DEPTH_RGB = (200, 200, 200), (255, 200, 0), (255, 235, 150), (180, 0, 180)
