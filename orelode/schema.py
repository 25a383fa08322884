"""Schema of report records."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

S, D, N, L = StringType(), DoubleType(), IntegerType(), ArrayType(StringType())


def struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


GRADE = struct(commodity=S, grade_value=D, grade_unit=S, contained_metal=D, contained_metal_unit=S)
ESTIMATE = struct(category=S, commodity=S, zone=S, cut_off_grade=S, tonnes=D, grades=ArrayType(GRADE), effective_date=S)
PROPERTY = struct(project_name=S, country=S, region=S, coordinates=S, latitude=D, longitude=D, jurisdiction=S, exchange_listed=S, project_stage=S, area_hectares=D, ownership=S, commodities=L, tenure_status=S, accessibility=S, infrastructure=S)
ECONOMICS = struct(study_type=S, study_effective_date=S, pre_tax_npv=S, post_tax_npv=S, irr=S, payback_years=D, discount_rate=S, initial_capex=S, sustaining_capex=S, total_capex=S, opex=S, mine_life_years=D, throughput_tpd=D, strip_ratio=S, recovery_rate=S, royalties=S, metal_price_assumptions=L)
GEOLOGY = struct(deposit_type=S, geological_age=S, host_rock=S, mineralization_style=S, structural_controls=S, alteration=S, historical_production=S)
EXPLORATION = struct(total_drill_holes=N, total_metres_drilled=D, drilling_types=L, last_program_date=S, sampling_methods=S, notable_intercepts=L, geophysical_surveys=L)
MINING = struct(method=S, mining_rate_tpd=D, strip_ratio=S, dilution=S, mine_recovery=S, key_equipment=L)
PROCESSING = struct(method=S, throughput_tpd=D, recoveries=L, concentrate_grade=S, tailings_management=S)
ENVIRONMENT = struct(permit_status=S, key_permits_required=L, environmental_studies_completed=L, tailings_facility=S, water_management=S, closure_cost=S, indigenous_consultation=S, political_risk_flags=L)
PERSON = struct(name=S, credentials=S, responsibility=S)
REPORT = struct(
    source_file=S, report_title=S, report_date=S, report_purpose=S, previous_resource_date=S, issuer=S, authors=L, summary=S, property_info=PROPERTY, mineral_resources=ArrayType(ESTIMATE), mineral_reserves=ArrayType(ESTIMATE),
    economics=ECONOMICS, geology=GEOLOGY, exploration=EXPLORATION, mining_method=MINING, processing=PROCESSING, environmental=ENVIRONMENT, qualified_persons=ArrayType(PERSON),
    study_stage=S, deposit_type=S, primary_mining_method=S, processing_route=S, ore_type=S, cutoff_type=S, economic_year=S, effective_date=S, primary_commodity=S)
SURVEY = struct(depth_m=D, azimuth=D, dip=D)
SPATIAL = struct(
    source_file=S, coordinate_system=S, boreholes=ArrayType(struct(hole_id=S, x=D, y=D, z_collar=D, azimuth=D, dip=D, total_depth_m=D, survey_points=ArrayType(SURVEY), source=S)),
    lithology_intervals=ArrayType(struct(hole_id=S, from_m=D, to_m=D, unit_name=S, description=S, source=S)), stratigraphic_pile=ArrayType(struct(unit_name=S, series_name=S, order_top_down=N, relative_age=S, source=S)),
    orientations=ArrayType(struct(surface_name=S, x=D, y=D, z=D, location_description=S, dip=D, dip_direction=D, polarity=N, source=S)),
    faults=ArrayType(struct(fault_name=S, dip=D, dip_direction=D, trace_description=S, offset_sense=S, affected_units=L, source=S)), cross_section_points=ArrayType(struct(section_id=S, surface_name=S, x=D, y=D, z=D, source=S)), notes=S, confirmed=BooleanType())
