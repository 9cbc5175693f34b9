"""Tunable values of the engine; operators take them as arguments, so Catalyst sees literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    latitude: float | None = None
    longitude: float | None = None
    bbox: tuple[float, float, float, float] | None = None
    target_date: str | None = None
    max_historical_images: int = 15
    search_window_days: int = 365
    cloud_cover_threshold: float = 20.0
    stac_collection: str = "sentinel-2-l2a"
    point_buffer_deg: float = 0.02
    orb_features: int = 2000
    ransac_reproj_threshold: float = 5.0
    min_match_count: int = 10
    cloud_prob_threshold: float = 0.22
    thin_cloud_threshold: float = 0.10
    use_adaptive_threshold: bool = True
    adaptive_block_size: int = 101
    adaptive_offset: float = 0.06
    morph_kernel_size: int = 5
    min_object_size: int = 40
    min_hole_size: int = 64
    border_ring_px: int = 3
    halo_search_px: int = 10
    halo_brightness_margin: float = 0.05
    dilation_scale: float = 0.30
    dilation_min_px: int = 3
    dilation_max_px: int = 25
    scl_cloud_classes: tuple[int, ...] = (8, 9, 10, 11)
    scl_shadow_class: int = 3
    shadow_dark_percentile: float = 20.0
    sun_azimuth_deg: float | None = None
    sun_elevation_deg: float | None = None
    assumed_cloud_height_px: float = 25.0
    shadow_grow_px: int = 3
    stack_band_count: int = 4
    spectral_similarity_sigma: float = 0.08
    uploaded_reference_weight: float = 1.5
    local_color_window: int = 41
    local_match_margin: int = 40
    feather_radius: int = 15
    pyramid_levels: int = 5
    use_poisson_blending: bool = True
    texture_refinement_strength: float = 0.55
    texture_blur_sigma: float = 3.0
    use_ai_inpainting: bool = True
    debug_mode: bool = True
    output_root: str = "outputs"
    export_compression: str = "LZW"
