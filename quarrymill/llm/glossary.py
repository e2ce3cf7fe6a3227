"""Names in general use for the entries of the reference lists: a table that a caller gives to the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in general use for parts of computers, by list and entry.
GLOSSARY = {
    "component_type": {
        "Processor": "cpu; central processing unit; microprocessor; processor unit; 中央处理器; 微处理器",
        "Graphics Card": "gpu; graphics adapter; video card; vga card; display card; 显示卡; 独立显卡; 图形卡",
        "Motherboard": "mainboard; main board; mobo; system board; logic board; 主机板; 母板",
        "Memory Module": "ram; dimm; memory; memory stick; system memory; ddr memory; 内存条; 记忆体",
        "Solid State Drive": "ssd; solid-state disk; flash disk; 固态; 固态驱动器; 固态盘",
        "Hard Disk Drive": "hdd; hard disk; hard drive; spinning disk; 硬盘; 机械盘",
        "Power Supply": "psu; power supply unit; power unit; 电源供应器",
        "Computer Case": "case; pc case; chassis; tower case; mid-tower; full tower; 机壳",
        "CPU Cooler": "cooler; cpu fan; heatsink; heat sink; liquid cooler; 风冷; 水冷; 风冷散热; 水冷散热; 风扇",
        "Display": "monitor; screen; lcd; 屏幕; 液晶屏",
        "Keyboard": "kbd",
        "Mouse": "mice; 滑鼠",
        "Headset": "headphones; earphones; headphone; 耳麦",
        "Network Adapter": "nic; network card; lan card; wifi card; wi-fi card; ethernet adapter; ethernet card",
        "Webcam": "web camera; camera; usb camera; video camera",
    },
    "category": {
        "Processors": "cpu; cpus; processor",
        "Graphics": "gpu; gpus; graphics card; graphics cards; video card; video cards; 显卡; 显示卡",
        "Mainboards": "motherboard; motherboards; system board; system boards; mobo; 主机板",
        "System Memory": "ram; dimm; dimms; memory module; memory modules; memory; 内存条; 记忆体",
        "Internal Storage": "ssd; hdd; hard drive; hard drives; internal hard drive; solid state drive; solid state drives; 固态硬盘; 机械硬盘",
        "External Storage": "usb flash drive; usb flash drives; portable drive; portable drives; external drive; external hard drive; memory card; memory cards; u盘; 移动硬盘; 存储卡",
        "Power Supplies": "psu; psus; power supply; 电源供应器",
        "Enclosures": "pc case; pc cases; case; cases; chassis; tower case; 机壳",
        "Cooling": "cooler; coolers; fan; fans; heatsink; heatsinks; liquid cooling; 散热器; 风扇; 水冷; 风冷",
        "Displays": "monitor; monitors; screen; screens; lcd screens; 显示器; 屏幕; 液晶屏",
        "Input Devices": "keyboard; keyboards; mouse; mice; gamepad; gamepads; 键盘; 鼠标; 手柄; 键鼠套装",
        "Audio Devices": "headset; headsets; headphones; speaker; speakers; sound card; sound cards; microphone; microphones; 耳机; 耳麦; 音箱; 麦克风; 声卡",
        "Networking": "router; routers; switch; switches; network card; network cards; 路由器; 交换机; 网卡",
        "Printing": "printer; printers; scanner; scanners; 打印机; 扫描仪",
    },
}


def glossary_of(reference: DataFrame, glossary: dict[str, dict[str, str]] = GLOSSARY) -> DataFrame:
    """``ref_id, name`` of the further names of the entries that a reference list has."""
    rows = [(kind, entry, name.strip()) for kind, entries in glossary.items() for entry, names in entries.items() for name in names.split(";")]
    names = reference.sparkSession.createDataFrame(rows, "list_name string, canonical_name string, name string")
    return reference.select("ref_id", "list_name", "canonical_name").join(F.broadcast(names), ["list_name", "canonical_name"]).select("ref_id", "name")
